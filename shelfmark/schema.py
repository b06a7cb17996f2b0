"""Fixed values of the catalog engine and the schemas of its tables."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values of retrieval, edges, chunks, planning and reports.
MAX_TOP = 20
MIN_SCORE = 0.35
TIE_RATIO = 0.95
IDF_CAP = 25.0
EVIDENCE_GATE = 6.0
GATE_POOL = 200.0
LOCATION_WEIGHT = {0: 1.0, 1: 0.75, 2: 0.5}  # name, trigger, description
NAME_FACTOR = 2.0
PINNED_FACTOR = 1.3
REFERENCES_BONUS = 0.5
LONG_TAIL = 0.25
EDGE_MIN_JACCARD = 0.12
EDGE_TOP_K = 6
EDGE_DF = (2, 40)
EDGE_GROUP = (2, 40)
EDGE_CLIQUE = 6
SIMILAR_TOP_K = 3
SIMILAR_MIN_SHARED = 3
EDGE_WEIGHT = {"depends_on": 0.8, "contains": 0.7, "family": 1.0}
DENSE_DESCRIPTION = 400
DENSE_TRIGGERS = 8
CHUNK_LINES = 50
CHUNK_OVERLAP = 5
CHUNK_MIN_LINES = 5
CHUNK_SUMMARY = 80
CHUNKS_PER_SKILL = 200
FILE_BYTES = 500_000
FED_PER_SKILL, FED_FILES = 50, 5
SEEDS, EXPANDED, STAGE_SKILLS = 6, 9, 3
DOCTOR_WEIGHT = 15
DOCTOR_BIG = 20_000
LEDGER_BYTES, LEDGER_KEEP = 2_000_000, 0.66
PROMOTE_AT = 3
HEARTBEAT = 300  # seconds
RECENT_EVENTS = 200
CORRECTION_LINES = 400
HUB_FACTOR, HUB_LEAST, HUB_PRUNES = 3, 5, 50

ENTRY = (
    "name string, type string, description string, description_zh string, triggers array<string>, path string, source string, has_references boolean, "
    "mtime bigint, visibility string, excluded boolean, exclude_reason string, agents array<string>, agent_bound boolean, category string, platform string, full_text string"
)
EDGE = "source string, target string, type string, direction string, weight double"
CHUNK = "skill string, file string, s int, e int, summary string, text string"
HIT_EVENT = "ts timestamp, kind string, query string, n_hits int, top array<struct<name:string,score:double,evidence:array<string>>>, agent string, skill string"
USAGE_EVENT = "ts timestamp, cmd string, chars bigint"


@dataclass(frozen=True)
class Search:
    """Options of a retrieval."""

    top: int = 8
    min_score: float = MIN_SCORE
    include_excluded: bool = False
    include_off_list: bool = False
    agent_only: bool = False
    bridge: bool = False
    pinned: tuple[str, ...] = ()
    self_name: str = "shelfmark"

    @property
    def limit(self) -> int:
        return max(1, min(self.top, MAX_TOP))
