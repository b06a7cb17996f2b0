"""The catalog's functions for SQL: temporary functions of a session, all of them expressions, and the table function of segments."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "shelfmark_terms(t STRING) RETURNS ARRAY<STRING>": """array_distinct(concat(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]{2,}', 0),
        flatten(transform(regexp_extract_all(lower(coalesce(t, '')), '[\\\\u4e00-\\\\u9fff]+', 0), r -> flatten(transform(array(2, 3), n ->
            if(length(r) >= n, transform(sequence(1, length(r) - n + 1), i -> substring(r, i, n)), cast(array() as array<string>))))))))""",
    "shelfmark_tokens(chars BIGINT) RETURNS BIGINT": "cast(bround(cast(chars as double) / 4, 0) as bigint)",
    "shelfmark_weight(t STRING) RETURNS INT": "length(t) + length(regexp_replace(t, '[\\\\u0000-\\\\u2e80]', ''))",
    "shelfmark_maximal(found ARRAY<STRING>, query STRING) RETURNS ARRAY<STRING>": """filter(found, t -> not exists(found, o -> o <> t and (contains(o, t) or (position(t, lower(query)) > 0 and position(o, lower(query)) > 0
        and (length(o) > length(t) or (length(o) = length(t) and o < t)) and 2 * (least(position(t, lower(query)) + length(t), position(o, lower(query)) + length(o)) - greatest(position(t, lower(query)), position(o, lower(query)))) > least(length(t), length(o))))))""",
    "shelfmark_one_line(t STRING) RETURNS STRING": "trim(regexp_replace(coalesce(t, ''), '\\\\s+', ' '))",
    "shelfmark_dense_line(name STRING, type STRING, has_references BOOLEAN, description STRING, triggers ARRAY<STRING>) RETURNS STRING": """concat(name, '[', case type when 'skill' then 's' when 'agent' then 'a' when 'connector' then 'c' else 'm' end, if(coalesce(has_references, false), 'R', ''), ']: ',
        if(length(shelfmark_one_line(description)) > 400, concat(left(shelfmark_one_line(description), 400), '…'), shelfmark_one_line(description)),
        if(size(filter(coalesce(triggers, cast(array() as array<string>)), t -> t <> '')) > 0, concat(' | 触发: ', array_join(slice(filter(triggers, t -> t <> ''), 1, 8), '、')), ''))""",
    "shelfmark_identifier_parts(t STRING) RETURNS ARRAY<STRING>": "array_distinct(concat(array(t), filter(split(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '$1 $2')), '[-_:. /]+'), p -> length(p) > 1)))",
}


def register(spark: SparkSession) -> None:
    from shelfmark.functions import manifest
    from shelfmark.operators import chunks

    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    chunks.register(spark)
    manifest.register(spark)
