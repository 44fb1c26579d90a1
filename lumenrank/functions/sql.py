"""The text functions under SQL names, as temporary SQL functions: plain expressions that Catalyst inlines."""

from pyspark.sql import SparkSession

from .text import TOKEN
from .values import STOP_WORDS

_WHITE = r"' \t\n\r\u000b\u000c'"
_STOP = "array(" + ", ".join("'" + w.replace("'", r"\'") + "'" for w in sorted(STOP_WORDS)) + ")"

#: name: (parameters, type, body). Later bodies may call earlier functions.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "rank_normalize": ("t STRING", "STRING", f"replace(replace(replace(lower(trim(BOTH {_WHITE} FROM t)), 'sci-fi', 'science fiction'), 'sci fi', 'science fiction'), 'scifi', 'science fiction')"),
    "rank_term_list": ("t STRING", "ARRAY<STRING>", f"filter(regexp_extract_all(rank_normalize(coalesce(t, '')), \"{TOKEN}\", 0), x -> NOT array_contains({_STOP}, x))"),
    "rank_tokens": ("t STRING", "ARRAY<STRING>", "array_distinct(rank_term_list(t))"),
    "rank_stem": (
        "w STRING",
        "STRING",
        "CASE WHEN length(w) <= 3 OR NOT endswith(w, 's') THEN w WHEN endswith(w, 'ies') AND length(w) > 4 THEN concat(left(w, length(w) - 3), 'y') "
        "WHEN (right(w, 4) IN ('ches', 'shes', 'sses') OR right(w, 3) IN ('xes', 'zes', 'oes')) AND length(w) > 4 THEN left(w, length(w) - 2) WHEN right(w, 2) NOT IN ('ss', 'us', 'is') THEN left(w, length(w) - 1) ELSE w END",
    ),
    "rank_csv_set": ("t STRING", "ARRAY<STRING>", "array_distinct(filter(transform(split(coalesce(t, ''), ','), x -> lower(trim(x))), x -> x <> ''))"),
    "rank_csv_head": ("t STRING, n INT", "STRING", "array_join(slice(filter(transform(split(t, ','), x -> trim(x)), x -> x <> ''), 1, n), ', ')"),
    "rank_title_root": (
        "t STRING",
        "STRING",
        r"trim(regexp_replace(trim(regexp_replace(substring_index(substring_index(rank_normalize(coalesce(t, '')), ' - ', 1), ':', 1), r'(?s)(?<!\w)(part|chapter|episode|vol|volume)(?!\w).*$', '')), r'(?<!\w)\d+(?!\w)$', ''))",
    ),
    "rank_mentions": ("t STRING, p STRING", "BOOLEAN", r"regexp_like(lower(t), concat('(^|[^a-z0-9])', regexp_replace(p, r'([\\.\[\]{}()*+?^$|\-])', r'\\$1'), '([^a-z0-9]|$)'))"),
    "rank_bm25": ("tf DOUBLE, dl DOUBLE, avgdl DOUBLE, idf DOUBLE", "DOUBLE", "CASE WHEN tf > 0 THEN idf * tf * 2.45D / (tf + 1.45D * (1 - 0.72D + 0.72D * dl / greatest(avgdl, 1.0D))) ELSE 0.0D END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
