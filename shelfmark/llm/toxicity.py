"""A toxicity classifier with a counterfactual penalty, learnt here and applied to whole texts.

Features say whether a word, or a beginning of one, occurs in a text. Identity terms come in forms: plurals, possessives,
derived words and compounds by FORMS; no form has beginnings, so a swap changes a text's features in those words only. Weights
are evidence for toxicity and never negative. Training minimises logistic loss, an L2 penalty, and the squared change of the
score's logit when a form in a labelled text is swapped for the same form of another term of its kind, or left out: what a
text says must not depend on which group it names, nor on its naming one. The logit is paired, not the probability: toxic
texts are near 1 whatever they name, so a change of their probability would let a weight stand that a neutral sentence bears
alone. The model is a bounded list of hashes and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, tidy, whole_text
from shelfmark.llm.hashing import ALNUM_LOWER, Words, runs_by_bytes

SAMPLE = 12_000  # labelled texts that the classifier is fitted on, at most about so many
FEATURES = 3_000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
PENALTY = 10.0

#: Identity terms by kind; a term is swapped for others of its kind. Replaceable by the caller.
IDENTITY_TERMS = {
    "gender": ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual", "queer"),
    "religion": ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    "origin": ("black", "white", "asian", "african", "european", "american", "mexican", "arab", "latino", "immigrant", "refugee"),
    "age and ability": ("old", "young", "elderly", "teenage", "disabled", "blind", "deaf", "autistic"),
}

#: What stands before and after a term in its forms; and endings that may fall away before them.
FORMS = (("", "non", "anti", "pro", "ex"), ("", "s", "es", "\u2019s", "s\u2019", "ity", "ness", "ism", "ist", "ists", "hood", "ish"))
ENDINGS = ("ist", "ish")


def form(term: str, before: str, after: str) -> set[str]:
    return {before + root + after for root in (term, *(term.removesuffix(e) for e in ENDINGS))}


def forms(terms: dict[str, tuple[str, ...]]) -> list[np.ndarray]:
    """Sorted hashes of words that swap with each other: one form of all terms of a kind."""
    groups = [[w.encode() for t in group for w in sorted(form(t, before, after))] for group in terms.values() for before in FORMS[0] for after in FORMS[1]]
    hashes = Words([w for g in groups for w in g], ALNUM_LOWER).hashes  # each is one word
    return [np.unique(x) for x in np.split(hashes, np.cumsum([len(g) for g in groups])[:-1])]


def features(texts: list[bytes], bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and beginnings of longer words of each text, with the text's number, for all texts together.

    bare: sorted hashes of the words that have no beginnings.
    """
    words = Words(texts, ALNUM_LOWER, PREFIXES)
    owner = np.repeat(np.arange(len(texts)), words.last - words.first)
    whole = bare[np.minimum(np.searchsorted(bare, words.hashes), len(bare) - 1)] == words.hashes if len(bare) else np.zeros(len(words.hashes), bool)
    hashes, owners = [words.hashes], [owner]
    for at, heads in words.heads.values():
        cut = ~whole[at]
        hashes.append(heads[cut])
        owners.append(owner[at[cut]])
    return np.concatenate(hashes), np.concatenate(owners)


def word_hash(word: str) -> int:
    return int(Words([word.encode()], ALNUM_LOWER).hashes[0])


def identity_hashes(terms: dict[str, tuple[str, ...]]) -> np.ndarray:
    """Of all forms of all terms, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *forms(terms)]))


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    bare: np.ndarray  # sorted hashes of the identity terms' forms

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for a, b in runs_by_bytes(texts):
            if len(self.hashes):
                found, owner = features(texts[a:b], self.bare)
                at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                hit = self.hashes[at] == found
                pairs = np.unique(owner[hit] * len(self.hashes) + at[hit])
                np.add.at(out[a:b], pairs // len(self.hashes), self.weights[pairs % len(self.hashes)])
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(rows: list[np.ndarray], labels: np.ndarray, known: np.ndarray, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, n_features: int = FEATURES, penalty: float = PENALTY, l2: float = 1e-3, steps: int = 600) -> Model:
    """known: sorted feature hashes; rows: of each labelled text the numbers of those that it has. Without labels of both kinds the score is constant."""
    n, n_pos = len(rows), int(labels.sum())
    prior = (n_pos + 0.5) / (n + 1)
    if n_pos in (0, n):
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior))), identity_hashes(terms))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    df = np.bincount(flat, minlength=len(known))
    pos = np.bincount(flat[labels[owner] == 1], minlength=len(known))
    expected = df * (n_pos / n)
    # Only evidence for toxicity counts: what is merely usual in other texts would let a long text hide it.
    chi = np.where((df >= 3) & (pos > expected), (np.abs(pos - expected) - 0.5) ** 2 / np.maximum(expected * (1 - n_pos / n), 1e-9), 0)
    identity = forms(terms)
    best = np.argsort(-chi, kind="stable")[: min(n_features, int((chi > 0).sum()))]
    chosen = np.union1d(known[best], np.concatenate(identity) if identity else np.empty(0, np.uint64))
    to = np.full(len(known), -1, np.int32)
    at = np.minimum(np.searchsorted(known, chosen), max(len(known) - 1, 0))
    there = known[at] == chosen
    to[at[there]] = np.flatnonzero(there)
    hit = to[flat] >= 0
    r, c = owner[hit], to[flat[hit]]
    # The swaps: in each text, each form for the same of each other term of its kind, and for none (the last number, of no weight).
    swaps: dict[tuple[int, int], int] = {}
    texts_with = np.bincount(c, minlength=len(chosen))
    for group in identity:
        at = np.searchsorted(chosen, group)
        for f in at[texts_with[at] > 0].tolist():
            for g in [*at.tolist(), len(chosen)]:
                if g != f:
                    swaps[f, g] = swaps.get((f, g), 0) + int(texts_with[f])
    one, other = (np.array([k[i] for k in swaps], int) for i in (0, 1))
    share = np.array(list(swaps.values()), float) / n
    w, b, y = np.zeros(len(chosen)), float(np.log(prior / (1 - prior))), labels.astype(float)
    m_w, v_w, m_b, v_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam over the full sample
        z = np.bincount(r, weights=w[c], minlength=n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        grad = np.bincount(c, weights=g[r], minlength=len(w)) + l2 * w / len(w) * 10
        if len(share):
            change = 2 * penalty * share * (w[one] - np.r_[w, 0.0][other])
            grad += (np.bincount(one, weights=change, minlength=len(w) + 1) - np.bincount(other, weights=change, minlength=len(w) + 1))[:-1]
        g_b = g.sum()
        m_w, v_w = 0.9 * m_w + 0.1 * grad, 0.999 * v_w + 0.001 * grad**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.999 * v_b + 0.001 * g_b**2
        rate = 0.1 * (1 - t / (steps + 1))
        w -= rate * (m_w / (1 - 0.9**t)) / (np.sqrt(v_w / (1 - 0.999**t)) + 1e-8)
        np.maximum(w, 0, out=w)
        b -= rate * (m_b / (1 - 0.9**t)) / (np.sqrt(v_b / (1 - 0.999**t)) + 1e-8)
    return Model(chosen, w, float(b), identity_hashes(terms))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the doc_id as text leaves 1 by 3: such rows never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, **options) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out; rows without label or doc_id teach nothing.

    A doc_id labelled twice is toxic if any label says so. The sample is by a hash of doc_id, so it is the same each time.
    Features are those of two toxic texts of the sample or more; only their numbers come to the driver. Null texts are empty;
    repeated documents teach once for each row; without documents or labels of both kinds the score is constant. A text of any
    length is read whole, in slices, and leaves its features alone. Of docs only doc_id and text are read, of labels doc_id and toxic, so other columns may have any name.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic")).filter(~held_out(F.col("_id")))
    n = known.count()
    if n > sample:
        known = known.filter(F.shiftrightunsigned(F.xxhash64("_id", F.lit(7)), 11) < int(2**53 * (sample / n)))
    texts = docs.select(F.col("doc_id").alias("_doc"), whole_text().alias("_text"))
    taught = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("_toxic", "_text")  # sample rows at most, about

    identity = identity_hashes(terms)

    def extract(chosen):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = chosen.value if chosen else None
            for batch in batches:
                for part, texts in slices(batch, 1):
                    out = []
                    for a, b in runs_by_bytes(texts):
                        found, owner = features(texts[a:b], identity)
                        if wanted is not None:
                            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                            hit = wanted[at] == found
                            found, owner = at[hit].astype(np.int32), owner[hit]
                        order = np.argsort(owner, kind="stable")
                        cuts = np.searchsorted(owner[order], np.arange(b - a + 1))
                        out += [np.unique(found[order[x:y]]).tobytes() for x, y in zip(cuts, cuts[1:])]
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), pa.array(out, pa.binary())], names=["y", "x"])

        return work

    toxic = taught.filter("_toxic = 1").mapInArrow(tidy(extract(None)), "y int, x binary").toArrow()
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in toxic["x"]]
    del toxic
    every, often = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.empty(0, np.uint64), np.empty(0, int))
    candidates = np.union1d(every[often > 1], identity)
    shared = docs.sparkSession.sparkContext.broadcast(candidates)
    rows = taught.mapInArrow(tidy(extract(shared)), "y int, x binary").toArrow()
    return fit([np.frombuffer(x.as_py(), np.int32) for x in rows["x"]], np.array(rows["y"], int), candidates, terms, **options)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; null and empty texts get the model's base score.

    Repeated rows and null doc_ids keep their rows (a null doc_id is not held out); texts of any length are read whole, in
    slices; an empty table gives no rows; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                scores = shared.value.score(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= threshold).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("_text"))
    return rows.mapInArrow(tidy(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, unchanged, whatever their names.

    Null and empty texts have the model's base score; each repeated row is judged alike; texts of any length are read whole,
    in slices; an empty table stays empty.
    """
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, where):
                yield part.filter(pa.array(shared.value.score(texts) < threshold))

    return docs.mapInArrow(tidy(work), docs.schema)
