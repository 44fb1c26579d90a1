"""Queries over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import sql as sql_names
from .functions import text as T
from .functions import values as V
from .functions.json_object import extract_object
from .operators import answers, blockmax, dense, enrichment, evaluation, hooks, index, lexical, matching, parsing, prompts, quality, ranking, selection
from .plans import recall
from .plans import recommend as plan
from .plans import service
from .sources import catalogue
from .sources.stages import folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUESTION = "the and of tion ing with"
#: Wishes with places for a part's name, brand and type, two years and a digit. Each part makes one of them.
WISHES = [
    "something between {y2} and {y1} with action", "best films of the 1990s", "an 80s horror classic", "recent comedy under 2 hours", "a movie set in the 1970s",
    "drama after {y1} without romance", "thriller since {y2}, not scary", "made before {y1}", "a korean film from {y2}", "no war, but family friendly",
    "over 2.5 hours epic length", "something quick", "", "war of {y1} rated r-rated", "sci-fi like {name} prior to {y2}", "avoid slow films instead give action",
    "i prefer films since {y2}", "older than {y1} please", "older films about {name}", "newer than {y1}, around {y2}", "from the {y1} war", "post {y1} noir, non-{type}", "the last decade", "from this decade",
    "she dislikes slow films but wants a heist", "hates {name} movies; loves rain", "doesn't like musical numbers, do not like gore with blood", "non fiction, non-horror", "no sci-fi or westerns except {brand}",
    "under 2 hours, epic", "at least 90 minutes, short", "max 1.5 hrs", "more than {n} h", "up to 100 minutes and over 80 mins", "less than 0 minutes", "a light watch", "light-hearted, lengthy",
    "rating above {n}", "rated at least {n}.5", "above 8 on imdb", "higher than 6.5/10 imdb score", "score >= {n}", "over 7 rating", "imdb rating over 6",
    "a thriller in a modern setting", "period drama for jazz fans", "set in the past with {name} fans", "set during {y1} for noir fans and western fans", "set in the {y1} and released after {y2}", "present-day spy story", "set in the 80s",
    "my sister loves heist movies, and I like slow burn drama", "likes quiet films; loves rain.", "he likes  old   trains.", "loves {name}", "likes a, likes b, likes c, likes d",
    "chinese cinema with subtitles", "a k-drama or a japanese film", "foreign film, subtitled", "latin american, not mexican", "an international nollywood hit", "dubbed anime", "the original language", "middle eastern or israeli",
    "pg-13 please", "pg13 or pg", "kid-friendly, not adult", "mature, r rated", "for children", "family-friendly kids movie",
    "a coming-of-age sports film", "courtroom or biopic", "zombie martial arts", "time travel, indie", "a psychological slasher", "superhero spy",
    "greatest films of all time", "the best war movie ever of all time", "all-time favorite", "must-watch masterpiece", "highly rated and acclaimed", "crowd pleasing", "top {n}",
    "fast-paced and exciting", "a high energy race", "fast movie", "something like {name}, in the vein of {brand}", "along the lines of {name}", "cozy, uplifting, mind-bending", "Weird Bleak DYSTOPIAN tone",
    "movies with {name} starring {brand}", "please recommend films directed by someone", "what to watch", "wants watches likes misses boxes stories", "classic", "an old classic and older", "latest {brand}", "no", "without ", "not {name}, not {brand}, no {type}, without x, avoid y, no z, not w",
]
#: More wishes, so that parts make a prime number of kinds.
WISHES += ["a {type} film from {y2} with no {brand} in it", "no {name} from {y1}"]


#: White space, as SQL.
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


#: (request_id, text): a wish of each part, then every turn of a conversation and every benchmark item.
_ASKED = f"""asked AS (SELECT 'p' || p_partkey AS request_id, replace(replace(replace(replace(replace(replace([{_sql_list(WISHES)}][p_partkey % {len(WISHES)} + 1], '{{name}}', p_name), '{{brand}}', p_brand), '{{type}}', p_type),
'{{y1}}', (1950 + p_size)::VARCHAR), '{{y2}}', (2024 - p_partkey % 40)::VARCHAR), '{{n}}', (p_partkey % 10)::VARCHAR) AS text FROM part
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark)"""
#: The same in lower case, trimmed, with one spelling for science fiction.
_T = f"{_ASKED}, said AS (SELECT request_id, text, replace(replace(replace(lower(trim(coalesce(text, ''), {_WS})), 'scifi', 'science fiction'), 'sci-fi', 'science fiction'), 'sci fi', 'science fiction') AS t FROM asked)"


def requests(spark: SparkSession, d: str) -> DataFrame:
    wish = F.element_at(F.array(*map(F.lit, WISHES)), (F.col("p_partkey") % len(WISHES) + 1).cast("int"))
    marks = {"name": F.col("p_name"), "brand": F.col("p_brand"), "type": F.col("p_type"), "y1": (1950 + F.col("p_size")).cast("string"), "y2": (2024 - F.col("p_partkey") % 40).cast("string"), "n": (F.col("p_partkey") % 10).cast("string")}
    for mark, value in marks.items():
        wish = F.replace(wish, F.lit("{" + mark + "}"), value)
    parts = catalogue.dealt(t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("request_id"), wish.alias("text"))
    talks = t(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"), "text")
    items = t(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("request_id"), "text")
    return parts.unionByName(talks).unionByName(items)


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in V.STOP_WORDS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents, for work on whole texts: a single small file is dealt over all cores."""
    return catalogue.spread(t(spark, d, "documents").select("doc_id", "text", "source"))


def _norm_sql(col: str) -> str:
    return f"replace(replace(replace(lower(trim(coalesce({col}, ''), {_WS})), 'scifi', 'science fiction'), 'sci-fi', 'science fiction'), 'sci fi', 'science fiction')"


def _terms_sql(col: str) -> str:
    return f"list_filter(regexp_extract_all({_norm_sql(col)}, '[a-z0-9'']+'), lambda x: x NOT IN ({_STOP}))"


def _stem_sql(x: str) -> str:
    return f"""CASE WHEN length({x}) <= 3 THEN {x} WHEN {x} LIKE '%ies' AND length({x}) > 4 THEN left({x}, length({x}) - 3) || 'y'
      WHEN regexp_matches({x}, '(ches|shes|xes|zes|sses|oes)$') AND length({x}) > 4 THEN left({x}, length({x}) - 2)
      WHEN {x} LIKE '%s' AND NOT regexp_matches({x}, '(ss|us|is)$') THEN left({x}, length({x}) - 1) ELSE {x} END"""


_STEMS = f"SELECT doc, term, word FROM (SELECT doc_id AS doc, {_stem_sql('w')} AS term, w AS word FROM (SELECT doc_id, unnest({_terms_sql('text')}) AS w FROM documents)) WHERE term NOT IN ({_STOP})"
_INDEX = f"""terms AS ({_STEMS}), postings AS (SELECT doc, term, count(*)::DOUBLE AS tf FROM terms GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
stats AS (SELECT term, count(*) AS df, ln((any_value(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM postings, n GROUP BY term),
lens AS (SELECT doc, greatest(sum(tf), 1.0) AS dl FROM postings GROUP BY doc), av AS (SELECT avg(dl) AS avgdl FROM lens)"""
_BM25 = "idf * tf * 2.45 / (tf + 1.45 * (1 - 0.72 + 0.72 * dl / greatest(avgdl, 1.0)))"


@query(f"SELECT w AS token, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest({_terms_sql('text')}) AS w FROM documents) GROUP BY w")
def tokenize_docs(spark, d):
    docs = texts(spark, d)
    rows = index.exploded_tokens(docs.select("doc_id", "text"), F.col("text")).drop("text")
    return rows.groupBy("doc_id", "token").count().groupBy("token").agg(F.count("*").alias("df"), F.sum("count").alias("n"))


@query(f"SELECT term, count(DISTINCT word) AS n_words, count(*) AS n FROM ({_STEMS}) GROUP BY term")
def stem_terms(spark, d):
    docs = texts(spark, d).select("text")
    words = index.exploded_tokens(docs, F.col("text")).groupBy(F.col("token").alias("word")).count()
    return words.withColumn("term", T.stem(F.col("word"))).filter(~F.col("term").isin(V.STOP_WORDS)).groupBy("term").agg(F.count("*").alias("n_words"), F.sum("count").alias("n"))


@query(f"""SELECT doc, term, sum(w) AS tf FROM (SELECT doc, term, 1.0::DOUBLE AS w FROM ({_STEMS}) UNION ALL
SELECT doc, {_stem_sql('w')}, 3.0 FROM (SELECT doc_id AS doc, unnest({_terms_sql('source')}) AS w FROM documents)) WHERE term NOT IN ({_STOP}) GROUP BY doc, term""")
def weighted_tf(spark, d):
    return index.weighted_terms(texts(spark, d), {"text": 1.0, "source": 3.0}, "doc_id")


@query(f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM stats")
def idf_stats(spark, d):
    docs = texts(spark, d)
    return index.term_stats(index.weighted_terms(docs, {"text": 1.0}, "doc_id"), index.counted(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {_INDEX} SELECT doc, term, tf, rank FROM (SELECT doc, term, tf, row_number() OVER (PARTITION BY doc ORDER BY round(tf * idf, 9) DESC, tf DESC, term DESC) AS rank
FROM postings JOIN stats USING (term)) WHERE rank <= 18""")
def overview_topterms(spark, d):
    docs = texts(spark, d)
    post = written(index.weighted_terms(docs, {"text": 1.0}, "doc_id"), "postings")
    return index.top_terms(post, index.term_stats(post, index.counted(docs))).select("doc", "term", "tf", "rank")


def _bm25(spark, d, asked):
    return lexical.search(lexical.query_terms(asked), *index.build(texts(spark, d), "doc_id", {"text": 1.0}))


_RANKED = """scored AS (SELECT request_id, doc, round(sum(qtf * {b}), 6) AS raw FROM q JOIN postings USING (term) JOIN stats USING (term) JOIN lens USING (doc), av GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY raw DESC, doc) AS r FROM scored WHERE raw > 0 QUALIFY r <= 80)
SELECT request_id, doc, raw AS bm25_raw, r AS bm25_rank, round((raw - min(raw) OVER (PARTITION BY request_id)) / greatest(max(raw) OVER (PARTITION BY request_id) - min(raw) OVER (PARTITION BY request_id), 1e-6), 6) AS bm25_score FROM top""".format(b=_BM25)


@query(f"""WITH {_INDEX}, q AS (SELECT 0 AS request_id, {_stem_sql('w')} AS term, count(*) AS qtf FROM (SELECT unnest({_terms_sql(repr(QUESTION))}) AS w) WHERE {_stem_sql('w')} NOT IN ({_STOP}) GROUP BY ALL), {_RANKED}""")
def bm25_topk(spark, d):
    asked = spark.createDataFrame([(0, QUESTION)], "request_id int, text string")
    return _bm25(spark, d, asked).withColumn("bm25_score", F.round("bm25_score", 6))


@query(f"""WITH {_INDEX}, q AS (SELECT request_id, {_stem_sql('w')} AS term, count(*) AS qtf FROM (SELECT item_id AS request_id, unnest({_terms_sql('text')}) AS w FROM benchmark) WHERE {_stem_sql('w')} NOT IN ({_STOP}) GROUP BY ALL), {_RANKED}""")
def bm25_batch(spark, d):
    return _bm25(spark, d, t(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text")).withColumn("bm25_score", F.round("bm25_score", 6))


def written_index(spark, d) -> tuple[DataFrame, DataFrame]:
    """The index of all documents with its blocks' bounds, written and read back."""
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    blockmax.write(*index.build(texts(spark, d), "doc_id", {"text": 1.0}), path)
    return blockmax.read(spark, path)


@query(SQL["bm25_batch"])
def bm25_blocks(spark, d):
    """The same rows from a written index, whose blocks' bounds leave out what can't be among the first."""
    asked = t(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    return blockmax.search(lexical.query_terms(asked), written_index(spark, d)).withColumn("bm25_score", F.round("bm25_score", 6))


_COS = """SELECT q.vec_id AS request_id, e.vec_id AS doc, round((list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) + 1) / 2, 6) AS s
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id"""
_DENSE = f"dense AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, doc) AS r FROM ({_COS}) QUALIFY r <= 30)"


def _dense(spark, d):
    e = t(spark, d, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    return dense.search(asked, e.select(F.col("vec_id").alias("doc"), "embedding"), asked.select("request_id", F.col("request_id").alias("doc")))


@query(f"WITH {_DENSE} SELECT request_id, doc, s AS sem_score, r AS sem_rank FROM dense")
def cosine_topk(spark, d):
    return _dense(spark, d).select("request_id", "doc", "sem_score", "sem_rank")


@query(f"""WITH {_INDEX}, q AS (SELECT item_id AS request_id, {_stem_sql('w')} AS term, count(*) AS qtf FROM (SELECT item_id, unnest({_terms_sql('text')}) AS w FROM benchmark WHERE item_id % 50 = 0) WHERE {_stem_sql('w')} NOT IN ({_STOP}) GROUP BY ALL),
hits AS (WITH {_RANKED}), {_DENSE},
f AS (SELECT coalesce(h.request_id, e.request_id) AS request_id, coalesce(h.doc, e.doc) AS doc, coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + e.r), 0) AS vote
  FROM hits h FULL JOIN dense e ON h.request_id = e.request_id AND h.doc = e.doc)
SELECT request_id, doc, round(vote, 6) AS vote, round(vote / max(vote) OVER (PARTITION BY request_id), 6) AS vote_score FROM f""")
def rrf_fusion(spark, d):
    asked = t(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("request_id"), "text")
    fused = ranking.fuse(_bm25(spark, d, asked), _dense(spark, d))
    return fused.select("request_id", "doc", F.round("vote", 6).alias("vote"), F.round("vote_score", 6).alias("vote_score"))


_PARTS = "parts AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, least(10, p_retailprice / 200) AS rating, coalesce(sum(l_quantity), 0) AS votes FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"


def _parts(spark, d):
    sold = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("votes"))
    p = t(spark, d, "part")
    return p.join(sold, p["p_partkey"] == sold["l_partkey"], "left").drop("l_partkey").na.fill(0.0, ["votes"]).withColumn("rating", F.least(F.lit(10.0), F.col("p_retailprice") / 200))


_QUALITY = f"""{_PARTS}, st AS (SELECT coalesce(avg(nullif(rating, 0)), 6) AS c, greatest(300, quantile_cont(votes, 0.7)) AS m, max(votes) AS top FROM parts),
q AS (SELECT parts.*, votes / (votes + m) * rating + m / (votes + m) * c AS bayes, least(greatest(ln(1 + votes) / greatest(ln(1 + top), 1), 0), 1) AS rel FROM parts, st),
qq AS (SELECT *, 0.72 * bayes / 10 + 0.28 * rel AS consensus FROM q)"""


@query(f"WITH {_QUALITY} SELECT p_partkey, round(bayes, 6) AS bayesian, round(rel, 6) AS reliability, round(consensus, 6) AS consensus FROM qq")
def bayes_quality(spark, d):
    return quality.add_quality(_parts(spark, d)).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("bayesian", "reliability", "consensus")])


@query("SELECT c_custkey, least(greatest(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE c_nationkey END / 1000, 0), 10) AS effective FROM customer")
def effective_rating(spark, d):
    value = quality.effective(F.col("c_acctbal"), F.col("c_nationkey").cast("double")) / 1000
    return t(spark, d, "customer").select("c_custkey", N.clip(value, 0.0, 10.0).alias("effective"))


_LAST = "last AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"


def _last(spark, d):
    return ranking.first_by(t(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


_RATED = """rated AS (SELECT 'tt' || o_custkey % 997 AS imdb_id, max(o_orderdate)::DATE::VARCHAR AS updated_at, count(*)::VARCHAR AS imdb_votes FROM orders GROUP BY 1)"""


@query(f"""WITH {_RATED} SELECT c_custkey::VARCHAR AS tmdb_id, imdb_id, imdb_votes, updated_at FROM customer JOIN rated ON imdb_id = 'tt' || c_custkey % 1500 WHERE c_custkey % 7 <> 3""")
def rating_overlay(spark, d):
    """Ratings meet items on an id that some items leave blank."""
    item = F.when(F.col("c_custkey") % 7 == 3, F.lit(" ")).otherwise(F.concat(F.lit(" tt"), (F.col("c_custkey") % 1500).cast("string")))
    rated = t(spark, d, "orders").groupBy(F.concat(F.lit("tt"), (F.col("o_custkey") % 997).cast("string")).alias("imdb_id")).agg(F.count("*").cast("string").alias("imdb_votes"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("updated_at"))
    return quality.overlay_of(t(spark, d, "customer").select(F.col("c_custkey").alias("tmdb_id"), item.alias("imdb_id")), rated)


@query(f"""WITH {_LAST} SELECT c_custkey, coalesce(nullif(trim(o_orderpriority), ''), c_mktsegment) AS c_mktsegment,
coalesce(nullif(trim(o_orderpriority), ''), c_mktsegment) IS DISTINCT FROM c_mktsegment AS changed FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def overlay_apply(spark, d):
    new = _last(spark, d).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"))
    return quality.apply_overlay(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), new, "c_custkey", ["c_mktsegment"])


@query(f"""WITH {_LAST}, o AS (SELECT o_custkey * 2 AS k, CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS v FROM last), c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '1-URGENT' ELSE c_mktsegment END AS v FROM customer)
SELECT count(c.k) AS total, count(o.k) AS overlay, count(*) FILTER (c.k IS NOT NULL AND trim(o.v) <> '' AND o.v = c.v) AS current, count(*) FILTER (c.k IS NOT NULL AND trim(o.v) <> '' AND o.v <> c.v) AS needing,
count(*) FILTER (c.k IS NULL AND trim(o.v) <> '') AS unmatched FROM c FULL JOIN o USING (k)""")
def overlay_status(spark, d):
    new = _last(spark, d).select((F.col("o_custkey") * 2).alias("k"), F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("v"))
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 0, "1-URGENT").otherwise(F.col("c_mktsegment")).alias("v"))
    return quality.overlay_status(old, new, "k", ["v"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def history_exclusion(spark, d):
    seen = t(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return ranking.without(t(spark, d, "part"), seen, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def candidate_semi(spark, d):
    hits = t(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return ranking.only(t(spark, d, "part"), hits, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE o_custkey % 9 > 0 AND year(o_orderdate) BETWEEN 1991 + o_custkey % 9 AND 1996")
def year_range(spark, d):
    o = t(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("bigint"))
    span = F.when(F.col("o_custkey") % 9 > 0, F.struct((F.lit(1991) + F.col("o_custkey") % 9).alias("min"), F.lit(1996).alias("max")))
    return o.filter(matching.year_match(F.col("y"), span)).select("o_orderkey", "y")


@query("SELECT p_partkey, p_size FROM part WHERE (p_partkey % 4 = 1 AND p_size >= 10) OR (p_partkey % 4 = 2 AND p_size <= 20) OR (p_partkey % 4 = 3 AND p_size BETWEEN 10 AND 20)")
def runtime_range(spark, d):
    key = F.col("p_partkey") % 4
    span = F.struct(F.when(key.isin(1, 3), 10).alias("min"), F.when(key.isin(2, 3), 20).alias("max"))
    return t(spark, d, "part").filter(matching.runtime_match(F.col("p_size"), span)).select("p_partkey", "p_size")


@query("""WITH s AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS words, list_distinct(string_split(lower(p_name), ' ') || [lower(p_type)]) AS w2 FROM part)
SELECT p_partkey, len(list_intersect(words, ['red', 'blue', 'small', 'ring']))::INT AS overlap, list_has_any(w2, ['steel', 'bolt']) AS other FROM s WHERE list_has_any(words, ['red', 'blue', 'small', 'ring'])""")
def genre_overlap(spark, d):
    s = t(spark, d, "part").select("p_partkey", "p_type", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words"))
    want, more = F.array(*map(F.lit, ("red", "blue", "small", "ring"))), F.array(F.lit("steel"), F.lit("bolt"))
    other = matching.overlaps(F.array_union("words", F.array(F.lower("p_type"))), more)
    return s.filter(matching.overlaps(F.col("words"), want)).select("p_partkey", F.size(F.array_intersect("words", want)).alias("overlap"), other.alias("other"))


@query(f"""SELECT doc_id, list_has_any({_terms_sql('text')}, ['idiot', 'password', 'loser']) OR contains(lower(text), 'token =') OR lang = 'de' AS avoid_hit FROM documents""")
def avoid_hits(spark, d):
    listed = lambda *xs: F.array(*map(F.lit, xs))
    hit = matching.avoid_hit(T.tokens(F.col("text")), F.lower("text"), F.array("lang"), listed("idiot", "password", "loser"), listed("token ="), listed("de"))
    return t(spark, d, "documents").select("doc_id", hit.alias("avoid_hit"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN lower(n_name) IN ('france', 'china') WHEN 2 THEN contains(lower(r_name), 'asia') ELSE true END AS language,
CASE WHEN c_custkey % 3 = 0 THEN true ELSE c_mktsegment IN ('BUILDING', 'MACHINERY') END AS certificate, c_custkey % 5 <> 0 AND NOT (c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0) AS eligible
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def item_gates(spark, d):
    """Language, place, certificate and eligibility gates, each with and without a wish."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    c = t(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    texts = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    key = F.col("c_custkey") % 4
    of = lambda codes, places: F.struct(texts(*codes).alias("codes"), texts(*places).alias("countries"))
    asked = F.when(key == 1, of(["france", "china"], ["asia"])).when(key == 2, of([], ["asia"])).when(key == 3, of([], []))
    allowed = F.when(F.col("c_custkey") % 3 != 0, texts("building", "machinery"))
    blocked = F.when(F.col("c_custkey") % 2 == 0, texts("FURNITURE")).otherwise(texts())
    seen = F.when(F.col("c_custkey") % 5 == 0, F.array("c_custkey")).otherwise(F.array().cast("array<bigint>"))
    return c.select("c_custkey", matching.language_match(F.col("n_name"), F.col("r_name"), asked).alias("language"), matching.certificate_match(F.col("c_mktsegment"), allowed).alias("certificate"), matching.eligible(F.col("c_custkey"), seen, F.array("c_mktsegment"), blocked).alias("eligible"))


@query("""SELECT p_partkey, p_size % 4 > 0 AND p_size % 3 = 0 AND NOT ((p_partkey % 3 = 0 OR p_partkey % 4 >= least(2, p_partkey % 3)) AND p_type <> 'SMALL' AND (p_partkey % 2 = 0 OR p_size % 4 / 4.0 >= 0.72)) AS doubtful,
(CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 8.0 ELSE 7.4 END ELSE 6.5 END)::DOUBLE AS floor, (CASE WHEN p_partkey % 5 = 0 THEN 8.0 WHEN p_partkey % 2 = 0 THEN 7.4 ELSE 7.2 END)::DOUBLE AS backup_floor,
p_retailprice / 125 >= 7.4 AND p_size * 50 >= 1000 AS well_rated FROM part""")
def recall_trust(spark, d):
    """Trust in rows that dense recall alone found, and quality floors."""
    key, size = F.col("p_partkey"), F.col("p_size")
    doubt = matching.doubtful(size % 4 / 4.0, (size % 3).cast("double"), key % 4, key % 3, F.col("p_type") == "SMALL", key % 2)
    quality_, ever = key % 2 == 0, key % 5 == 0
    rated = matching.well_rated(F.col("p_retailprice") / 125, size * 50, F.lit(7.4))
    return t(spark, d, "part").select("p_partkey", doubt.alias("doubtful"), matching.quality_floor(quality_, ever).alias("floor"), matching.quality_floor(quality_, ever, backup=True).alias("backup_floor"), rated.alias("well_rated"))


_WORD = "[a-z0-9]+"


@query(f"""WITH dict AS (SELECT DISTINCT lower(n_name) AS phrase FROM nation UNION SELECT unnest(['of the', 'the and', 'de la', 'in the', 'that the the and'])),
docs AS (SELECT doc_id, {_norm_sql('text')} AS low FROM documents)
SELECT doc_id, phrase FROM docs JOIN dict ON contains(low, phrase) AND regexp_matches(low, '(^|[^a-z0-9])' || phrase || '([^a-z0-9]|$)')""")
def phrase_match(spark, d):
    """Dictionary phrases by an equality join on their first words, verified at their borders, in passages of bounded length."""
    more = spark.createDataFrame([(x,) for x in ("of the", "the and", "de la", "in the", "that the the and")], "name string")
    dictionary = t(spark, d, "nation").select(F.lower("n_name").alias("name")).union(more).distinct()
    docs = texts(spark, d).select(F.col("doc_id").alias("request_id"), "text")
    return parsing.met(docs, dictionary).select(F.col("request_id").alias("doc_id"), F.col("name").alias("phrase"))


@query("""SELECT p_partkey, p_brand FROM part QUALIFY CASE WHEN count(*) FILTER (p_retailprice > 990) OVER (PARTITION BY p_brand) >= least(8, count(*) OVER (PARTITION BY p_brand)) THEN p_retailprice > 990 ELSE true END""")
def guarded_filter(spark, d):
    p = t(spark, d, "part").withColumns({"request_id": F.col("p_brand"), "present": F.lit(True)})
    return ranking.narrow(p, F.col("p_retailprice") > 990, 8, F.lit(True)).filter("present").select("p_partkey", "p_brand")


@query("""WITH base AS (SELECT p_brand, p_partkey, CASE WHEN p_size < 3 THEN 'size' WHEN p_size = 3 THEN 'kept' ELSE '' END AS constraint_source, p_size AS bm25_rank FROM part WHERE p_size < 5),
extra AS (SELECT p_brand, p_partkey FROM part WHERE p_size BETWEEN 5 AND 11 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3)
SELECT * FROM base UNION ALL SELECT p_brand, p_partkey, 'size', NULL FROM extra""")
def append_missing(spark, d):
    """Rows that match and are there get the source unless they have one; the best three that aren't there come in without recall."""
    size = F.col("p_size")
    p = t(spark, d, "part").withColumns({"request_id": F.col("p_brand"), "present": size < 5, "constraint_source": F.when(size == 3, "kept").otherwise(""), "bm25_rank": size, "sem_rank": size, "bm25_score": F.lit(0.5), "sem_score": F.lit(0.5), "vote_score": F.lit(0.5)})
    out = ranking.tag_or_append(p, (size < 3) | size.between(5, 11), "size", [F.desc("p_retailprice"), F.col("p_partkey")], 3)
    return out.filter("present").select("p_brand", "p_partkey", "constraint_source", "bm25_rank")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_retailprice DESC, p_partkey) > 1 AS late FROM part),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY late, p_retailprice DESC, p_partkey) <= 10)
SELECT p_type, p_brand, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM k""")
def diversify(spark, d):
    return ranking.diversify(t(spark, d, "part"), "p_brand", ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_type", "p_brand", "p_partkey", "rank")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first(spark, d):
    return ranking.first_by(t(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedupe_last(spark, d):
    return ranking.first_by(t(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


_LINE = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)"


@query(f"""WITH r AS (SELECT l_suppkey, l_extendedprice AS s, {_LINE} AS n FROM lineitem), g AS (SELECT l_suppkey, max(s) FILTER (n = 1) AS a, max(s) FILTER (n = 2) AS b, max(s) FILTER (n = 5) AS e FROM r GROUP BY ALL)
SELECT l_suppkey, a AS top, round(a - b, 6) AS gap2, round(a - e, 6) AS gap5 FROM g""")
def score_gaps(spark, d):
    gaps = ranking.score_gaps(t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], "l_extendedprice")
    return gaps.select("l_suppkey", "top", F.round("gap2", 6).alias("gap2"), F.round("gap5", 6).alias("gap5"))


_SOURCE = f"""{_QUALITY}, hit AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY consensus DESC, p_partkey) AS rank FROM qq),
s AS (SELECT p_partkey, p_brand, rating, votes, consensus, round(CASE WHEN p_size % 7 = 0 THEN -5000 ELSE 30.0 / (60 + rank) + CASE WHEN p_type LIKE '%STEEL%' OR p_size > 25 THEN 0.1 ELSE 0 END
  + CASE WHEN p_size BETWEEN 5 AND 15 THEN 0.08 ELSE 0 END + CASE WHEN p_retailprice > 990 THEN -0.35 ELSE 0 END + 0.12 * least(3, p_size % 5) + CASE WHEN p_size % 5 > 0 THEN 0.18 ELSE 0.25 END * consensus END, 6) AS score FROM hit)"""


def _scored(spark, d):
    p = quality.add_quality(_parts(spark, d))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("consensus"), "p_partkey")))
    no, size = F.lit(False), F.col("p_size")
    inputs = dict.fromkeys(("excluded", "wrong_certificate", "similar_request", "seed_overlap", "quality_request", "needs_backup", "person_match", "runtime_match"), no) | {
        "wrong_language": size % 7 == 0, "bm25_rank": F.col("rank"), "sem_rank": F.lit(None).cast("int"), "seed_relation": F.lit(""), "constraint_source": F.lit(""),
        "broad_request": F.lit(True), "subgenre_overlap": size % 5, "consensus": F.col("consensus"), "genre_match": F.col("p_type").like("%STEEL%") | (size > 25),
        "year_match": size.between(5, 15), "avoid_hit": F.col("p_retailprice") > 990,
    }
    return p.withColumn("score", F.round(ranking.source_score(inputs), 6))


@query(f"WITH {_SOURCE} SELECT p_partkey, score FROM s")
def source_score(spark, d):
    return _scored(spark, d).select("p_partkey", "score")


#: A leading row of each brand and size, with flags that its key makes up.
_LED = f"""{_SOURCE}, r AS (SELECT s.*, p_size, row_number() OVER (PARTITION BY s.p_brand, p_size ORDER BY score DESC, p_partkey) AS n FROM s JOIN part USING (p_partkey)),
g AS (SELECT p_brand, p_size, max(score) FILTER (n = 1) AS top, coalesce(max(score) FILTER (n = 1) - max(score) FILTER (n = 2), max(score) FILTER (n = 1)) AS gap1 FROM r GROUP BY p_brand, p_size),
led AS (SELECT r.p_partkey AS k, r.p_brand || '/' || r.p_size AS request_id, r.rating, r.votes * 10 AS votes, r.consensus, g.top, g.gap1 FROM r JOIN g USING (p_brand, p_size) WHERE n = 1)"""
_CLASH = "list_filter([CASE WHEN k % 2 = 0 AND k % 3 > 0 THEN 'genre_miss' END, CASE WHEN k % 7 = 0 AND k % 5 = 0 THEN 'avoid_hit' END, CASE WHEN k % 11 = 0 THEN 'person_miss' END, CASE WHEN k % 13 = 0 AND k % 2 = 1 THEN 'year_miss' END, CASE WHEN k % 17 = 0 THEN 'runtime_miss' END, CASE WHEN k % 4 = 0 AND k % 19 = 0 THEN 'seed_miss' END], lambda x: x IS NOT NULL)"


@query(f"""WITH {_LED}, f AS (SELECT *, {_CLASH} AS contradictions, k % 3 = 0 AS fuzzy, k % 5 = 1 AS wants_quality, CASE WHEN k % 6 = 1 THEN 4.8 END AS min_rating FROM led),
x AS (SELECT *, CASE WHEN wants_quality THEN rating >= 6.8 AND floor(votes) >= 500 AND consensus >= 0.6 ELSE rating >= 6.4 AND floor(votes) >= 120 AND consensus >= 0.55 END AS safe, len(contradictions) = 0 AS calm FROM f),
y AS (SELECT *, CASE WHEN calm AND top >= 0.5 AND gap1 >= 0.05 AND safe AND NOT fuzzy AND NOT (wants_quality AND k % 2 = 0) AND (min_rating IS NULL OR rating >= min_rating) THEN 'high' WHEN calm AND top >= 0.28 THEN 'medium' ELSE 'low' END AS confidence FROM x)
SELECT request_id, confidence, CASE WHEN confidence = 'high' THEN 'description_only' WHEN confidence = 'medium' AND NOT fuzzy THEN 'judge_5' ELSE 'judge_8' END AS route, array_to_string(contradictions, ',') AS contradictions,
CASE WHEN k % 2 = 0 AND k % 4 < 3 THEN CASE WHEN k % 3 = 1 THEN 'strong' ELSE 'partial' END WHEN k % 3 = 1 THEN 'partial' ELSE 'weak' END AS convergence,
CASE WHEN calm AND top >= 0.5 THEN 'high' WHEN calm AND top >= 0.28 THEN 'medium' ELSE 'low' END AS fulfilment FROM y""")
def confidence_route(spark, d):
    """The plan's confidence and route of leading rows, with their contradictions."""
    s, order = _scored(spark, d).withColumn("request_id", F.concat_ws("/", "p_brand", "p_size")), [F.desc("score"), F.col("p_partkey")]
    gaps = ranking.score_gaps(s, ["request_id"], order, "score").select("request_id", "top", F.coalesce("gap2", "top").alias("gap1"))
    k, yes = F.col("p_partkey"), F.lit(True)
    flags = {
        "has_genres": k % 2 == 0, "genre_match": k % 3 == 0, "has_avoid": k % 7 == 0, "avoid_hit": k % 5 == 0, "has_people": k % 11 == 0, "person_match": ~yes, "has_year": k % 13 == 0, "year_available": k % 2 == 1, "year_match": ~yes,
        "has_runtime": k % 17 == 0, "runtime_available": yes, "runtime_match": ~yes, "similar_request": k % 4 == 0, "seed_match": k % 19 != 0, "fuzzy": k % 3 == 0, "wants_quality": k % 5 == 1, "min_rating": F.when(k % 6 == 1, 4.8),
        "votes": F.floor(F.col("votes") * 10), "bm25_score": F.when(k % 2 == 0, 0.4).otherwise(0.0), "sem_score": F.when(k % 3 == 1, 0.7).otherwise(0.0),
    }
    led = ranking.first_by(s, ["request_id"], *order).withColumns(flags).join(gaps, "request_id")
    return selection.confidence(led).select("request_id", "confidence", "route", F.array_join("contradictions", ",").alias("contradictions"), "convergence", "fulfilment")


@query(f"""WITH {_SOURCE}, r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s),
v AS (SELECT p_brand, p_partkey, rank, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE rating * 1.4 END AS rating, votes * 3 AS votes, CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 3 = 0 OR p_brand = 'Brand#3' THEN 1 ELSE 0 END AS v FROM r),
m AS (SELECT *, v = min(v) OVER (PARTITION BY p_brand) AS viable FROM v), p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, viable ORDER BY rank) AS pos FROM m),
k AS (SELECT *, CASE WHEN viable AND rating >= 6.5 AND votes >= 500 AND pos <= 3 THEN 0 WHEN viable AND rating >= 6.5 AND votes >= 500 AND pos <= 5 THEN 1 WHEN viable AND rating > 0 THEN 2 ELSE 3 END AS tier FROM p)
SELECT p_brand, p_partkey FROM k QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY tier, CASE WHEN tier < 2 THEN -rating END, CASE WHEN tier < 2 THEN -votes END, rank) = 1""")
def argmax_select(spark, d):
    """The deterministic choice: viable rows first, then good ones of the first three and five."""
    k = F.col("p_partkey")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))
    df = _scored(spark, d).withColumn("rank", rank).withColumns({"avoid_hit": k % 4 == 0, "genre_match": k % 3 != 0, "person_match": F.col("p_brand") != "Brand#3", "rating": F.when(k % 9 == 0, 0.0).otherwise(F.col("rating") * 1.4), "votes": F.col("votes") * 3})
    df = df.withColumns({c: F.lit(True) for c in ("year_match", "runtime_match", "seed_match")})
    return selection.choose(df, ["p_brand"]).select("p_brand", "p_partkey")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", N.number(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT p_partkey, v, TRY_CAST(replace(regexp_replace(lower(trim(v)), '[km]$', ''), ',', '') AS DOUBLE) * CASE WHEN lower(trim(v)) LIKE '%k' THEN 1e3 WHEN lower(trim(v)) LIKE '%m' THEN 1e6 ELSE 1 END AS votes
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || 'k' WHEN 1 THEN '1,' || (100 + p_size) WHEN 2 THEN p_size || 'm ' ELSE 'n/a' END AS v FROM part)""")
def vote_suffix(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    v = F.when(key == 0, F.concat(size, F.lit("k"))).when(key == 1, F.concat(F.lit("1,"), (F.col("p_size") + 100).cast("string"))).when(key == 2, F.concat(size, F.lit("m "))).otherwise("n/a")
    return t(spark, d, "part").select("p_partkey", v.alias("v")).withColumn("votes", N.votes(F.col("v")))


@query(rf"""WITH {_T}, x AS (SELECT request_id, t, TRY_CAST(regexp_extract(t, '\bbetween\s+((?:19|20)\d{{2}})\s+and\s+((?:19|20)\d{{2}})\b', 1) AS INT) AS a, TRY_CAST(regexp_extract(t, '\bbetween\s+((?:19|20)\d{{2}})\s+and\s+((?:19|20)\d{{2}})\b', 2) AS INT) AS b,
TRY_CAST(regexp_extract(t, '\b((?:19|20)\d0)s\b', 1) AS INT) AS decade, 1900 + TRY_CAST(regexp_extract(t, '\b(80|90)s\b', 1) AS INT) AS short, TRY_CAST(regexp_extract(t, '(?s)^(.*?)\b((?:19|20)\d{{2}})\b', 2) AS INT) AS y, right(regexp_extract(t, '(?s)^(.*?)\b((?:19|20)\d{{2}})\b', 1), 24) AS pre FROM said),
k AS (SELECT *, CASE WHEN regexp_matches(t, '\bset (in|during)\b') AND NOT regexp_matches(t, '\b(released|release|made|produced|came out|from|movie from|film from|after|before|since|newer than|older than|between|recent|newer|latest|classic)\b') THEN 'none'
WHEN a IS NOT NULL THEN 'between' WHEN decade IS NOT NULL THEN 'decade' WHEN short IS NOT NULL THEN 'short' WHEN regexp_matches(t, '\b(recent|newer|latest)\b') THEN 'recent' WHEN regexp_matches(t, '\bthis decade\b') THEN 'this' WHEN regexp_matches(t, '\blast decade\b') THEN 'last'
WHEN regexp_matches(t, '\bclassic\b') OR (regexp_matches(t, '\bolder\b') AND regexp_matches(t, '\bold\b')) THEN 'classic' WHEN regexp_matches(t, '\bolder\b') THEN 'older' WHEN y IS NULL THEN 'none' WHEN regexp_matches(pre, '\b(after|post|newer than|since)\s+$') THEN 'after' WHEN regexp_matches(pre, '\b(before|pre|older than|prior to)\s+$') THEN 'before'
WHEN regexp_matches(pre, '\b(from|in|around)\s+(the\s+)?$') THEN 'exact' ELSE 'none' END AS rule FROM x)
SELECT request_id, CASE rule WHEN 'between' THEN least(a, b) WHEN 'decade' THEN decade WHEN 'short' THEN short WHEN 'recent' THEN 2019 WHEN 'this' THEN 2020 WHEN 'last' THEN 2010 WHEN 'classic' THEN 0 WHEN 'older' THEN 0
WHEN 'after' THEN y + (contains(pre, 'after') OR contains(pre, 'newer than') OR contains(pre, 'post'))::INT WHEN 'before' THEN 0 WHEN 'exact' THEN y END AS year_min,
CASE rule WHEN 'between' THEN greatest(a, b) WHEN 'decade' THEN decade + 9 WHEN 'short' THEN short + 9 WHEN 'recent' THEN 2024 WHEN 'this' THEN 2024 WHEN 'last' THEN 2019 WHEN 'classic' THEN 1990 WHEN 'older' THEN 2010 WHEN 'after' THEN 9999
WHEN 'before' THEN y - (contains(pre, 'before') OR contains(pre, 'older than') OR contains(pre, 'pre'))::INT WHEN 'exact' THEN y END AS year_max,
CASE rule WHEN 'between' THEN 'between ' || least(a, b) || ' and ' || greatest(a, b) WHEN 'decade' THEN decade || 's' WHEN 'short' THEN short || 's' WHEN 'recent' THEN 'recent' WHEN 'this' THEN 'this decade' WHEN 'last' THEN 'last decade' WHEN 'classic' THEN 'classic' WHEN 'older' THEN 'older'
WHEN 'after' THEN 'after ' || y WHEN 'before' THEN 'before ' || y WHEN 'exact' THEN y::VARCHAR END AS label FROM k""")
def year_parse(spark, d):
    text = F.col("text")
    got = requests(spark, d).select("request_id", parsing.year_range(text).alias("y"), parsing.year_label(text).alias("label"))
    return got.select("request_id", F.col("y.min").alias("year_min"), F.col("y.max").alias("year_max"), "label")


def _minutes(words: str) -> str:
    p = rf"\b(?:{words})\s+(\d+(?:\.\d+)?)\s*(hours?|hrs?|h|minutes?|mins?|m)?\b"
    return f"nullif(round_even(TRY_CAST(nullif(regexp_extract(t, '{p}', 1), '') AS DOUBLE) * CASE WHEN regexp_extract(t, '{p}', 2) LIKE 'h%' THEN 60 ELSE 1 END, 0)::INT, 0)"


@query(rf"""WITH {_T}, x AS (SELECT request_id, t, {_minutes('over|more than|at least|min(?:imum)?')} AS lo, {_minutes('under|less than|within|below|max(?:imum)?|up to')} AS hi FROM said)
SELECT request_id, coalesce(lo, CASE WHEN regexp_matches(t, '\b(long|epic|lengthy)\b') THEN 130 END) AS runtime_min, coalesce(hi, CASE WHEN regexp_matches(t, '\b(short|quick|brief|light)\b') THEN 110 END) AS runtime_max FROM x""")
def runtime_parse(spark, d):
    return requests(spark, d).select("request_id", parsing.runtime_range(F.col("text")).alias("r")).select("request_id", F.col("r.min").alias("runtime_min"), F.col("r.max").alias("runtime_max"))


_GENRE_ROWS = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(V.GENRES.items()))
_CLEAN = r"list_filter(list_transform({}, lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '')"
_PLAIN = _CLEAN.format(r"regexp_extract_all(t, '\b(?:no|not|without|avoid)\s+([a-z0-9][a-z0-9\-\s]{0,32}?)(?:,|\.|;|\bbut\b|\bexcept\b|\binstead\b|$)', 1)")
_HATED = _CLEAN.format(r"regexp_extract_all(t, '\b(?:dislikes?|hates?|doesn''?t like|do not like)\s+([a-z0-9][a-z0-9\-\s]{0,24}?)(?:,|\.|;|\bbut\b|\bwith\b|\bfilms?\b|\bmovies?\b|$)', 1)")
#: The three kinds of refusals of each text, and all of them.
_REFUSED = rf"""{_T}, refused AS (SELECT request_id, text, t, {_PLAIN} AS plain, regexp_extract_all(t, '\bnon[-\s]+([a-z0-9]+)\b', 1) AS non, {_HATED} AS hated FROM said),
g(alias, genre, ord) AS (VALUES {_GENRE_ROWS}),
blocks AS (SELECT DISTINCT request_id, genre FROM (SELECT request_id, unnest(plain || list_transform(plain, lambda p: replace(p, '-', ' '))) AS p FROM refused), g WHERE contains(p, alias) AND regexp_matches(p, '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)')
  UNION SELECT request_id, genre FROM (SELECT request_id, unnest(non || hated) AS p FROM refused) JOIN g ON alias = p),
blocked AS (SELECT request_id, list_sort(list(genre)) AS genres FROM blocks GROUP BY request_id)"""


@query(rf"""WITH {_REFUSED} SELECT request_id, array_to_string((plain || non || hated)[1:6], '|') AS phrases,
array_to_string(list_sort(list_distinct({_terms_sql("array_to_string(plain || non || hated, ' ')")} || CASE WHEN len(non) > 0 THEN ['non'] ELSE [] END)), ' ') AS words, coalesce(array_to_string(genres, ','), '') AS blocked
FROM refused LEFT JOIN blocked USING (request_id)""")
def negation_parse(spark, d):
    text = F.col("text")
    return requests(spark, d).select("request_id", F.array_join(parsing.negations(text), "|").alias("phrases"), F.array_join(F.sort_array(parsing.refused_tokens(text)), " ").alias("words"), F.array_join(parsing.blocked_genres(text), ",").alias("blocked"))


@query(rf"""WITH {_T} SELECT request_id, CASE WHEN regexp_matches(t, '\b(based in modern times|set in modern times|takes place in modern times|modern setting|modern day|modern-day|present day|present-day)\b') THEN 'contemporary setting'
WHEN regexp_matches(t, '\b(period piece|period drama|historical setting|set in the past)\b') THEN 'historical setting' WHEN regexp_matches(t, '\bset (in|during) (the )?((19|20)\d0s|80s|90s|(19|20)\d\d)\b')
THEN 'set in ' || regexp_extract(t, '\bset (?:in|during) (?:the )?((?:19|20)\d0s|80s|90s|(?:19|20)\d\d)\b', 1) ELSE '' END AS setting FROM said""")
def setting_parse(spark, d):
    return requests(spark, d).select("request_id", parsing.setting_period(F.col("text")).alias("setting"))


@query(rf"""WITH {_T}, x AS (SELECT request_id, regexp_extract(t, '\b(?:imdb\s+)?(?:rating|rated|score)\s*(?:above|over|at least|higher than|>=)\s*(\d(?:\.\d+)?)\b|\b(?:above|over|at least|higher than|>=)\s*(\d(?:\.\d+)?)\s*(?:/10)?\s*(?:imdb\s+)?(?:rating|rated|score)\b', ['a', 'b']) AS m FROM said),
y AS (SELECT request_id, TRY_CAST(coalesce(nullif(m.a, ''), m.b) AS DOUBLE) AS n FROM x) SELECT request_id, CASE WHEN n > 0 AND n <= 10 THEN n END AS min_rating FROM y""")
def rating_parse(spark, d):
    return requests(spark, d).select("request_id", parsing.min_rating(F.col("text")).alias("min_rating"))


@query(rf"""WITH {_T}, f AS (SELECT request_id, regexp_extract_all(t, '\b(?:likes?|loves?)\s+([a-z0-9][a-z0-9\-\s]{{0,32}}?)(?:\s+(?:films?|movies?)\b|,|\.|;|$)', 1) || regexp_extract_all(t, '\b([a-z0-9][a-z0-9\-\s]{{0,24}}?)\s+fans?\b', 1) AS ps FROM said),
u AS (SELECT request_id, generate_subscripts(ps, 1) AS i, trim(regexp_replace(unnest(ps), '\s+', ' ', 'g')) AS p FROM f), g AS (SELECT request_id, p, min(i) AS i FROM u WHERE p <> '' GROUP BY ALL)
SELECT request_id, string_agg(p, '|' ORDER BY i) AS phrases FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY i) <= 3) GROUP BY request_id""")
def affinity_parse(spark, d):
    return requests(spark, d).select("request_id", F.array_join(parsing.affinity_phrases(F.col("text")), "|").alias("phrases")).filter("phrases <> ''")


def _terms_of(table: dict, value) -> str:
    return ", ".join(f"('{k}', {i}, '{value(v)}')" for i, (k, v) in enumerate(table.items()))


def _asked_term_sql(table: dict, value) -> str:
    """The value of the longest mentioned term, the first of equals, and of the first of the table."""
    return rf"""WITH {_T}, d(term, ord, value) AS (VALUES {_terms_of(table, value)}),
m AS (SELECT request_id, term, ord, value FROM said JOIN d ON contains(t, term) AND regexp_matches(t, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)'))
SELECT request_id, arg_min(value, -length(term) * 1000 + ord) AS by_length, arg_min(value, ord) AS by_order FROM m GROUP BY request_id"""


@query(_asked_term_sql(V.LANGUAGES, lambda v: ",".join(v[0]) + "|" + ",".join(v[1])))
def language_parse(spark, d):
    """The language filter, by the longest term and by the table's order."""
    said = lambda c: F.concat(F.array_join(c["codes"], ","), F.lit("|"), F.array_join(c["countries"], ","))
    found = requests(spark, d).select("request_id", parsing.named(F.col("text"), V.LANGUAGES).alias("found")).filter("size(found) > 0")
    of = lambda strict: said(parsing.language_of(parsing.counted_term(F.col("found"), strict)))
    return found.select("request_id", of(False).alias("by_length"), of(True).alias("by_order"))


@query(_asked_term_sql(V.CERTIFICATES, ",".join))
def certificate_parse(spark, d):
    text = F.col("text")
    return requests(spark, d).select("request_id", F.array_join(parsing.certificates(text), ",").alias("by_length"), F.array_join(parsing.certificates(text, strict=True), ",").alias("by_order")).filter("by_length is not null")


_SUB_ROWS = ", ".join(f"('{k}', [{_sql_list(v)}])" for k, v in V.SUBGENRES.items())
_HEARD = rf"""g2(alias, genre) AS (SELECT alias, genre FROM (VALUES {_GENRE_ROWS}) v(alias, genre, ord)), sub(term, words) AS (VALUES {_SUB_ROWS}),
heard AS (SELECT request_id, list_sort(list(DISTINCT genre)) AS genres FROM said JOIN g2 ON contains(t, alias) AND regexp_matches(t, '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') GROUP BY request_id),
themed AS (SELECT request_id, list_sort(list_distinct(flatten(list(words)))) AS themes FROM said JOIN sub ON contains(t, term) AND regexp_matches(t, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY request_id)"""


@query(rf"""WITH {_T}, {_HEARD} SELECT request_id, coalesce(array_to_string(genres, ','), '') AS genres, coalesce(array_to_string(themes, ','), '') AS themes FROM said LEFT JOIN heard USING (request_id) LEFT JOIN themed USING (request_id)""")
def genre_parse(spark, d):
    text = F.col("text")
    return requests(spark, d).select("request_id", F.array_join(parsing.genres(text), ",").alias("genres"), F.array_join(F.sort_array(parsing.subgenre_keywords(text)), ",").alias("themes"))


_WORD_FLAGS = {
    "wants_all_time": r"\b(best|greatest|top)(\s+[a-z0-9]+){0,5}\s+(of\s+)?all\s+time\b|\ball[-\s]?time\s+(best|great|classic|favorite)\b",
    "similar": r"\b(like|similar to|something like|in the vein of|along the lines of)\b",
    "mood": r"\bfast[-\s]?paced\b|\bfast\s+movie\b|\bexciting\b|\bhigh[-\s]?energy\b",
    "fuzzy_words": r"\b(like|similar|vibe|feel|feels|style|mood|tone|atmospheric|thoughtful|weird|grounded|bleak|slow[-\s]?burn|dystopian|modern story|modern setting|epic|intense|tense|mind[-\s]?bending|light[-\s]?hearted|uplifting|heartwarming|charming|comfort|cozy)\b",
    "short_requested": r"\b(short|quick|brief|light)\b",
}
_GOOD = r"\b(good|great|best|top|high[-\s]?quality|high[-\s]?rated|highly rated|acclaimed|popular|crowd[-\s]?pleasing|well reviewed|must[-\s]?watch|greatest|masterpiece)\b"
_AGES = "['recent', 'newer', 'latest', 'older', 'classic', 'relatively new', 'new movie', 'older movie', 'old movie', 'this decade', 'last decade']"


@query(rf"""WITH {_T} SELECT request_id, {', '.join(f"regexp_matches(lower(t), '{p}') AS {k}" for k, p in _WORD_FLAGS.items())}, regexp_matches(t, '{_GOOD}') OR regexp_matches(t, '{_WORD_FLAGS['wants_all_time']}') AS wants_quality,
len(list_filter({_AGES}, lambda p: contains(t, p))) > 0 AS year_said FROM said""")
def request_profile(spark, d):
    got = parsing.profile(requests(spark, d))
    return got.select("request_id", "wants_all_time", F.col("similar_request").alias("similar"), "mood", "fuzzy_words", "short_requested", "wants_quality", "year_said")


@query(rf"""WITH {_T}, x AS (SELECT request_id, {_terms_sql('text')} AS ws FROM said) SELECT request_id, array_to_string(list_sort(list_distinct(ws)), ' ') AS tokens,
array_to_string(list_filter(list_transform(ws, lambda w: {_stem_sql('w')}), lambda w: w NOT IN ({_STOP})), ' ') AS stems FROM x""")
def request_tokens(spark, d):
    """Tokens as a set, and stemmed tokens in order, without the stop words that stemming makes."""
    return requests(spark, d).select("request_id", F.array_join(F.sort_array(T.tokens(F.col("text"))), " ").alias("tokens"), F.array_join(T.stems(F.col("text")), " ").alias("stems"))


_FILLERS, _QUALITY_FILLERS = _sql_list(V.REQUEST_FILLERS), _sql_list(V.QUALITY_FILLERS)


@query(rf"""WITH {_REFUSED}, {_HEARD}, y AS (SELECT r.request_id, text, regexp_matches(t, '{_GOOD}') OR regexp_matches(t, '{_WORD_FLAGS['wants_all_time']}') AS good, regexp_matches(t, '{_WORD_FLAGS['mood']}') AS mood,
  list_filter(coalesce(h.genres, []), lambda g: NOT list_contains(coalesce(b.genres, []), g)) AS genres, coalesce(themes, []) AS themes, {_terms_sql("array_to_string(plain || non || hated, ' ')")} || CASE WHEN len(non) > 0 THEN ['non'] ELSE [] END AS off
  FROM refused r LEFT JOIN blocked b USING (request_id) LEFT JOIN heard h USING (request_id) LEFT JOIN themed USING (request_id)),
q AS (SELECT request_id, list_sort(list_distinct(list_filter({_terms_sql('text')}, lambda w: NOT list_contains(off, w) AND w NOT IN ({_FILLERS}) AND NOT (good AND w IN ({_QUALITY_FILLERS})))
  || {_terms_sql("array_to_string(genres || themes, ' ')")} || CASE WHEN mood THEN ['speed', 'exciting', 'action', 'race', 'chase', 'suspenseful'] ELSE [] END)) AS words FROM y)
SELECT request_id, array_to_string(words, ' ') AS words FROM q""")
def query_words(spark, d):
    """The search words of requests of which the catalogue knows no name."""
    empty, ids = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    known = dict.fromkeys(("people", "countries", "affinity_terms", "seed_genres", "seed_keywords", "seed_title_tokens"), empty) | {"seed_docs": ids}
    return parsing.completed(parsing.profile(requests(spark, d)).withColumns(known)).select("request_id", F.array_join("query_tokens", " ").alias("words"))


#: Profiles that a part's numbers make up: lists, flags and values.
_MADE = """made AS (SELECT p_partkey AS k, p_partkey % 2 AS genres, (p_partkey // 2) % 2 AS avoid, (p_partkey // 4) % 2 AS people, (p_partkey // 8) % 2 AS year, (p_partkey // 16) % 2 AS rating, (p_partkey // 32) % 2 AS setting, (p_partkey // 64) % 2 AS alike,
(p_partkey // 128) % 3 AS tone, p_size % 2 AS runtime, p_size % 3 = 0 AS quality, p_size % 5 = 0 AS mood, p_size % 7 = 0 AS year_said, p_size % 11 < 4 AS fuzzy, p_size % 13 AS hits, (p_partkey // 3) % 2 AS liked FROM part)"""


def _made(spark, d) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    bit = lambda n, m=2: F.floor(k / n) % m
    some = lambda c: F.when(c > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "part").select(
        F.col("p_partkey").alias("request_id"), some(k % 2).alias("genres"), some(bit(2)).alias("avoid_phrases"), some(bit(4)).alias("people"), F.when(bit(8) > 0, F.struct(F.lit(1990).alias("min"), F.lit(1999).alias("max"))).alias("year"),
        F.when(bit(16) > 0, 7.0).alias("min_rating"), F.when(bit(32) > 0, "set in 1990").otherwise("").alias("setting"), (bit(64) > 0).alias("similar_request"), some(F.when(bit(128, 3) == 1, 1).otherwise(0)).alias("tone"), some(F.when(bit(128, 3) == 2, 1).otherwise(0)).alias("hints"),
        F.struct(F.when(size % 2 > 0, 90).alias("min"), F.lit(None).cast("int").alias("max")).alias("runtime"), (size % 3 == 0).alias("wants_quality"), (size % 5 == 0).alias("mood"), (size % 7 == 0).alias("year_said"), (size % 11 < 4).alias("fuzzy_words"), (size % 13).alias("hits"),
        some(F.floor(k / 3) % 2).alias("affinity_genres"), some(bit(1, 5)).alias("countries"), F.lit("label").alias("year_label"),
    )


@query(f"""WITH {_MADE}, n AS (SELECT *, genres + avoid + people + rating + setting + alike + runtime + (year > 0 OR year_said)::INT AS points, genres + avoid + people + rating + setting + alike + year + (tone > 0)::INT AS few FROM made),
b AS (SELECT *, quality OR (alike = 0 AND NOT mood AND few <= 1) AS broad FROM n)
SELECT k AS request_id, CASE WHEN points >= 3 THEN 'high' WHEN points = 2 THEN 'medium' ELSE 'low' END AS specificity, broad AS broad_request, broad OR alike > 0 OR (genres + liked > 0 AND people + year + runtime = 0) AS needs_backup,
CASE WHEN people > 0 AND NOT (alike > 0 OR setting > 0 OR tone > 0 OR fuzzy) THEN false WHEN alike > 0 OR setting > 0 THEN true WHEN tone > 0 THEN true WHEN fuzzy THEN true WHEN hits < 8 AND people = 0 THEN true ELSE false END AS wants_dense FROM b""")
def request_gates(spark, d):
    """Specificity, breadth, backup and the gate of dense recall."""
    got = parsing.breadth(_made(spark, d)).withColumn("wants_dense", parsing.wants_dense(F.col("hits")))
    return got.select("request_id", "specificity", "broad_request", "needs_backup", "wants_dense")


@query(f"""WITH {_MADE} SELECT k AS request_id, genres::INT AS n_genres, (tone = 1)::INT AS n_tone, (tone = 2)::INT AS n_hints, avoid::INT AS n_avoid, year > 0 OR year_said AS year_relevant, k % 5 > 0 AS country_relevant, CASE WHEN setting > 0 THEN 'set in 1990' ELSE '' END AS setting_period FROM made""")
def prompt_profile(spark, d):
    got = prompts.profile_of(_made(spark, d))
    size = lambda c: F.size(c)
    return got.select("request_id", size("target_genres").alias("n_genres"), size("tone").alias("n_tone"), size("keyword_hints").alias("n_hints"), size("avoid").alias("n_avoid"), "year_relevant", "country_relevant", "setting_period")


_TITLED = """titled AS (SELECT p_partkey AS doc, 'The ' || p_name || ': a tale of the ' || lower(p_type) || ' in ' || p_brand || ', part ' || p_size AS title FROM part)"""


@query(f"""WITH {_TITLED}, told AS (SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN 'something like the ' || p_name || ': a tale of the ' || lower(p_type) || ' in ' || p_brand || ', part ' || p_size || '! but newer' WHEN 1 THEN 'the ' || p_name || ': a tale of the ' || lower(p_type) || ' in ' || p_brand || ', part ' || p_size || '9'
ELSE 'a tale of the ' || lower(p_type) END AS text FROM part)
SELECT request_id, doc FROM told JOIN titled ON contains(lower(text), lower(title)) AND NOT regexp_matches(substr(lower(text), strpos(lower(text), lower(title)) + length(title), 1), '[a-z0-9]')""")
def mentioned_titles(spark, d):
    """Titles of nine words and more in requests, by their first words and then verified."""
    p = t(spark, d, "part")
    title = F.concat(F.lit("The "), "p_name", F.lit(": a tale of the "), F.lower("p_type"), F.lit(" in "), "p_brand", F.lit(", part "), F.col("p_size").cast("string"))
    key = F.col("p_partkey") % 3
    text = F.when(key == 0, F.concat(F.lit("something like "), F.lower(F.substring(title, 1, 4)), F.substring(title, 5, 500), F.lit("! but newer"))).when(key == 1, F.concat(F.lit("the "), F.substring(title, 5, 500), F.lit("9"))).otherwise(F.concat(F.lit("a tale of the "), F.lower("p_type")))
    asked = p.select(F.col("p_partkey").alias("request_id"), text.alias("text"))
    items = p.select(F.col("p_partkey").alias("doc"), title.alias("title"))
    return parsing.mentioned_items(asked, items, F.array("title"))


@query("""WITH items AS (SELECT p_partkey AS doc, p_name || ' ' || p_partkey % 700 AS title, 'Alt ' || p_partkey % 900 AS other FROM part), told AS (SELECT o_custkey AS request_id, o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 2500 END AS id,
  CASE o_orderkey % 4 WHEN 1 THEN 'small ring ' || o_orderkey % 800 WHEN 2 THEN ' SMALL ring ' || o_orderkey % 800 WHEN 3 THEN 'alt ' || o_orderkey % 1000 ELSE '' END AS name FROM orders),
m AS (SELECT request_id, n, doc, CASE WHEN name = title THEN 0 WHEN lower(trim(name)) IN (lower(title), lower(other)) THEN 1 ELSE 2 END AS tier FROM told JOIN items ON name = title OR (name <> '' AND (lower(trim(name)) = lower(title) OR lower(trim(name)) = lower(other))) OR id = doc),
f AS (SELECT *, min(tier) OVER (PARTITION BY request_id, n) AS first FROM m) SELECT request_id, doc, CASE min(tier) WHEN 0 THEN 'title' WHEN 1 THEN 'variant' ELSE 'id' END AS how FROM f WHERE tier = first GROUP BY request_id, doc""")
def history_resolve(spark, d):
    """Watched items by exact title, else by a variant of it, else by id."""
    p, n = t(spark, d, "part"), F.col("o_orderkey")
    items = p.select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 700).cast("string")).alias("title"), F.concat(F.lit("Alt "), (F.col("p_partkey") % 900).cast("string")).alias("other"))
    number = lambda m: (n % m).cast("string")
    name = F.when(n % 4 == 1, F.concat(F.lit("small ring "), number(800))).when(n % 4 == 2, F.concat(F.lit(" SMALL ring "), number(800))).when(n % 4 == 3, F.concat(F.lit("alt "), number(1000))).otherwise("")
    told = t(spark, d, "orders").select(F.col("o_custkey").alias("request_id"), F.when(n % 4 == 0, n % 2500).alias("id"), name.alias("name"))
    return parsing.resolved_history(told, items, F.array("title", "other"))


@query("""WITH i AS (SELECT p_partkey AS doc, p_brand, p_size, p_name FROM part) SELECT p_brand AS request_id, count(*) AS n_docs, array_to_string(list_sort(list(DISTINCT 'g' || p_size)), ',') AS genres, count(DISTINCT p_size % 4) AS n_keywords, list_sum(list_distinct(flatten(list([doc % 5, doc % 7]))))::BIGINT AS similar,
array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ' ') AS words FROM i GROUP BY p_brand""")
def seed_signals(spark, d):
    """What the items that a request names have in common."""
    doc, size = F.col("doc"), F.col("p_size").cast("string")
    p = t(spark, d, "part").withColumn("doc", F.col("p_partkey"))
    items = p.select("doc", F.col("p_name").alias("title"), F.array(doc % 5, doc % 7).alias("similar_ids"), F.array(doc % 3).alias("recommended_ids"), F.array(F.concat(F.lit("g"), size)).alias("genre_set"), F.array((F.col("p_size") % 4).cast("string")).alias("keyword_set"))
    got = parsing.seed_signals(p.select(F.col("p_brand").alias("request_id"), "doc"), items)
    return got.select("request_id", F.size("seed_docs").cast("bigint").alias("n_docs"), F.array_join(F.sort_array("seed_genres"), ",").alias("genres"), F.size("seed_keywords").cast("bigint").alias("n_keywords"), F.aggregate("seed_similar_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("similar"), F.array_join(F.sort_array("seed_title_tokens"), " ").alias("words"))


@query("SELECT DISTINCT unnest([lower(p_type), lower(p_brand)]) AS term FROM part")
def term_vocabulary(spark, d):
    return parsing.vocabulary(t(spark, d, "part").select(F.array(F.lower("p_type"), F.lower("p_brand")).alias("terms")), "terms")


_NAMED = """dict AS (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 1) FROM part),
said AS (SELECT p_partkey AS request_id, 'a ' || p_name || ' like ' || p_brand || ', but ' || p_type AS text FROM part)"""


@query(f"""WITH {_NAMED}, hits AS (SELECT request_id, name FROM said JOIN dict ON regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]' || name || '[^a-z0-9]')),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY length(name) DESC, name) AS n FROM hits) SELECT request_id, string_agg(name, '|' ORDER BY n) AS names FROM r WHERE n <= 6 GROUP BY request_id""")
def person_signals(spark, d):
    """Names of a dictionary in request texts, longest first, by an equality join on runs of words."""
    p = t(spark, d, "part")
    names = p.select(F.explode(F.array("p_brand", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("name"))
    said = p.select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("a "), "p_name", F.lit(" like "), "p_brand", F.lit(", but "), "p_type").alias("text"))
    return parsing.named_from(said, names, 6).select("request_id", F.array_join("names", "|").alias("names"))


@query("""WITH liked AS (SELECT DISTINCT lower(p_name) AS liked FROM part), met AS (SELECT liked, p_partkey, lower(p_type) AS genre, lower(p_brand) AS keyword, row_number() OVER (PARTITION BY liked ORDER BY p_partkey) AS n
  FROM liked JOIN part ON contains(lower(p_name) || ' ' || lower(p_type), liked)),
terms AS (SELECT liked, unnest(list_concat(list_distinct(regexp_extract_all(genre, '[a-z0-9'']+')), [])) AS term, 3 AS w FROM met WHERE n <= 40 UNION ALL
  SELECT liked, unnest(list_distinct(regexp_extract_all(keyword, '[a-z0-9'']+'))), 1 FROM met WHERE n <= 40),
r AS (SELECT liked, term, row_number() OVER (PARTITION BY liked ORDER BY sum(w) DESC, term) AS n FROM (SELECT liked, STEM AS term, w FROM terms) GROUP BY liked, term)
SELECT liked AS request_id, string_agg(term, '|' ORDER BY term) AS terms FROM r WHERE n <= 8 GROUP BY liked""".replace("STEM", _stem_sql("term")))
def affinity_terms(spark, d):
    """What the items behind a liked phrase have in common; each part name is a liked phrase."""
    p = t(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("doc"), F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")).alias("blob"), F.array(F.lower("p_type")).alias("genre_set"), F.array(F.lower("p_brand")).alias("keyword_set"))
    asked = p.select(F.lower("p_name").alias("request_id")).distinct().select("request_id", F.array("request_id").alias("affinity_phrases"), F.array().cast("array<string>").alias("avoid_terms"))
    return parsing.affinity_terms(asked, items).select("request_id", F.array_join("affinity_terms", "|").alias("terms"))


_LABELLED = "l AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, CASE WHEN quality = 1 THEN 'v2' WHEN toxic = 1 THEN 'error' ELSE '' END AS status, d.doc_id % 5 AS k FROM documents d LEFT JOIN labels USING (doc_id))"


def _labelled(spark, d) -> DataFrame:
    met = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    return met.withColumns({"status": F.when(F.col("quality") == 1, "v2").when(F.col("toxic") == 1, "error").otherwise(""), "k": F.col("doc_id") % 5})


@query(f"""WITH {_LABELLED} SELECT lang, count(*) AS rows_in_scope, count(*) FILTER (status = 'v2') AS rows_current, count(*) FILTER (status <> 'v2') AS rows_needing_enrichment FROM l GROUP BY lang""")
def status_counts(spark, d):
    return enrichment.metadata_status(_labelled(spark, d).withColumn(enrichment.STATUS, F.concat(F.lit(" "), "status")), by=["lang"], key="doc_id")


#: What items lack: an essence by key, tags by source, keywords by length.
_LACKS = """list_filter([CASE WHEN k IN (0, 1) THEN 'essence' END, CASE WHEN source = 'web' THEN 'tone_tags_json' END, CASE WHEN k = 2 THEN 'source_tags_json' END, CASE WHEN n_chars % 4 < 3 AND k < 3 THEN 'keywords_augmented_json' END, CASE WHEN k = 4 THEN 'audience_tags_json' END], lambda x: x IS NOT NULL)"""


def _lacking(spark, d) -> DataFrame:
    k, n = F.col("k"), F.col("n_chars") % 4
    fields = {
        "essence": F.when(k <= 1, " ").otherwise("long"), "tone_tags_json": F.when(F.col("source") == "web", None).otherwise("[]"), "source_tags_json": F.when(k == 2, "").otherwise('["original"]'),
        "keywords_augmented_json": F.when(k < 3, "").otherwise('["x"]'), "audience_tags_json": F.when(k == 4, "").otherwise("[]"),
        "keywords": F.array_join(F.slice(F.array(*map(F.lit, ("a", " ", "b", "c"))), F.lit(1), (n + 1).cast("int")), ","), enrichment.TAG_STATUS: F.col("status"),
    }
    return _labelled(spark, d).withColumns(fields)


@query(f"WITH {_LABELLED} SELECT doc_id, array_to_string({_LACKS}, ',') AS lacks FROM l")
def tags_needed(spark, d):
    return _lacking(spark, d).select("doc_id", F.array_join(enrichment.fields_to_generate(), ",").alias("lacks"))


@query(f"WITH {_LABELLED}, n AS (SELECT *, len({_LACKS}) > 0 AS needs FROM l) SELECT lang, count(*) AS rows_in_scope, count(*) FILTER (NOT needs) AS rows_complete, count(*) FILTER (needs) AS rows_needing_llm, count(*) FILTER (status = 'error') AS rows_error FROM n GROUP BY lang")
def tag_counts(spark, d):
    return enrichment.tag_status(_lacking(spark, d), by=["lang"])


def _canned(asked: list[str], options: dict) -> list[str | None]:
    """Answers by what a prompt tells of its item: tags, no object, or a failure."""
    if any("overview: fail" in p for p in asked):
        raise RuntimeError("no model")
    return ["nothing" if "overview: dumb" in p else '```json\n{"essence": " so  fine ", "tone_tags_json": ["Dark", "dark", "other"], "source_tags_json": "no list", "keywords_augmented_json": ["A_b", "a b"], "audience_tags_json": []}\n```' for p in asked]


@query("""WITH p AS (SELECT p_partkey AS tmdb_id, p_partkey % 4 AS k FROM part) SELECT tmdb_id, CASE WHEN k = 0 THEN 'so fine' WHEN k = 3 THEN 'old' ELSE '' END AS essence, CASE WHEN k IN (0, 3) THEN '["dark"]' ELSE '' END AS tone_tags_json, CASE WHEN k = 0 THEN '["a b"]' WHEN k = 3 THEN '[]' ELSE '' END AS keywords_augmented_json,
CASE WHEN k IN (0, 3) THEN 'ok' ELSE 'error' END AS status, CASE WHEN k IN (0, 3) THEN 'canned' ELSE '' END AS model, CASE k WHEN 1 THEN 'the answer holds no object' WHEN 2 THEN 'no model' ELSE '' END AS error FROM p""")
def tag_augment(spark, d):
    """Tags from a model that answers, answers nonsense or fails; rows that lack nothing are done without a call."""
    key = F.col("p_partkey") % 4
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("tmdb_id"), F.when(key == 1, "dumb").when(key == 2, "fail").otherwise("plain").alias("overview"), F.when(key == 3, "old").otherwise("").alias("essence"), F.when(key == 3, '["dark"]').otherwise("").alias("tone_tags_json"), *[F.when(key == 3, "[]").otherwise("").alias(c) for c in ("source_tags_json", "keywords_augmented_json", "audience_tags_json")], F.lit("").alias("keywords"))
    out = enrichment.augment(rows, _canned, "canned", batch=1)
    return out.select("tmdb_id", "essence", "tone_tags_json", "keywords_augmented_json", F.col(enrichment.TAG_STATUS).alias("status"), F.col(enrichment.TAG_MODEL).alias("model"), F.col(enrichment.TAG_ERROR).alias("error"))


@query("SELECT p_partkey AS doc, 8 AS dim, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS length FROM part")
def encoded_vectors(spark, d):
    """Unit vectors of texts; blank texts have a zero one."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("text"))
    return hooks.encode(rows, "doc", "text", hooks.hashing_encoder(8), 8).select("doc", F.size("embedding").alias("dim"), F.round(N.norm(F.col("embedding")), 3).alias("length"))


@query("""WITH e AS (SELECT lang, n_chars / 100.0::DOUBLE AS s, toxic, round((quality + (1 - toxic) + (n_chars > 300)::INT) / 3.0::DOUBLE, 2) AS m FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) AS n_cases, count(*) FILTER (toxic = 1) AS n_errors, round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s, min(s) AS min_s, max(s) AS max_s, round(avg(m), 6) AS mean_match,
count(*) FILTER (m = 1) AS n_perfect, count(*) FILTER (m > 0 AND m < 1) AS n_partial, count(*) FILTER (m = 0) AS n_zero FROM e GROUP BY lang""")
def eval_summary(spark, d):
    met = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").withColumn("s", F.col("n_chars") / 100.0)
    met = met.withColumns({"a": F.col("quality") == 1, "b": F.col("toxic") == 0, "c": F.col("n_chars") > 300})
    return selection.summary(selection.evaluate(met, ["a", "b", "c"]), "s", "match_score", F.col("toxic") == 1, ["lang"])


@query("""WITH e AS (SELECT lang, CASE WHEN doc_id % 9 = 0 THEN 'bad' ELSE '' END AS error, n_chars / 40.0::DOUBLE AS s, toxic = 1 AS llm, doc_id % 4 = 0 AS rep, doc_id % 3 = 0 AS past, (quality IS NOT NULL)::INT + (doc_id % 2) AS checked, CASE WHEN doc_id % 5 = 0 THEN 0.0 WHEN doc_id % 5 < 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS m,
  quality = 1 AS g, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 END AS p FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS n_cases, count(*) FILTER (error <> '') AS n_errors, round(avg(s) FILTER (error = ''), 6) AS mean_s, round(median(s) FILTER (error = ''), 6) AS median_s, min(s) FILTER (error = '') AS min_s, max(s) FILTER (error = '') AS max_s, round(avg((s < 20)::INT::DOUBLE) FILTER (error = ''), 6) AS share_in_time,
count(*) FILTER (llm) AS n_llm, count(*) FILTER (rep) AS n_repeats, count(*) FILTER (past) AS n_with_history, count(*) FILTER (checked > 0) AS n_constrained, round(avg(m) FILTER (checked > 0), 6) AS mean_match, count(*) FILTER (checked > 0 AND m = 1) AS n_perfect, count(*) FILTER (checked > 0 AND m > 0 AND m < 1) AS n_partial, count(*) FILTER (checked > 0 AND m = 0) AS n_zero,
round(avg(g::INT::DOUBLE) FILTER (checked > 0), 6) AS genre_match_rate, round(avg(p::INT::DOUBLE) FILTER (checked > 0), 6) AS person_match_rate, NULL::DOUBLE AS year_match_rate, round(avg((NOT g)::INT::DOUBLE) FILTER (checked > 0), 6) AS language_match_rate FROM e GROUP BY lang""")
def eval_report(spark, d):
    """The whole summary of results, over answers that documents and labels make up."""
    i = F.col("doc_id")
    df = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left").withColumns({
        "error": F.when(i % 9 == 0, "bad").otherwise(""), "runtime_s": F.col("n_chars") / 40.0, "used_llm": F.col("toxic") == 1, "history_repeat": i % 4 == 0, "has_history": i % 3 == 0, "checked": F.col("quality").isNotNull().cast("int") + i % 2,
        "match_score": F.when(i % 5 == 0, 0.0).when(i % 5 < 3, 0.5).otherwise(1.0), "genre_match": F.col("quality") == 1, "person_match": F.when(i % 2 == 0, i % 4 == 0), "year_match": F.lit(None).cast("boolean"), "language_match": F.col("quality") != 1,
    })
    return selection.report(df, ["lang"])


@query("SELECT event_type, count(*) AS n_runs, round(avg(value), 6) AS mean_s, min(value) AS min_s, max(value) AS max_s, count(*) FILTER (value >= 18) AS n_over FROM events GROUP BY event_type")
def eval_timing(spark, d):
    return evaluation.timing(t(spark, d, "events"), "value", 18.0, ["event_type"])


_FOR_CHECKS = "x AS (SELECT request_id, text, regexp_replace(trim(lower(coalesce(text, ''))), '\\s+', ' ', 'g') AS t, length(text) AS n FROM asked)"


@query(rf"""WITH {_ASKED}, {_FOR_CHECKS}, g(alias, genre, ord) AS (VALUES {_GENRE_ROWS}), d(term, ord, codes, places) AS (VALUES {", ".join(f"('{k}', {i}, [{_sql_list(v[0])}]::VARCHAR[], [{_sql_list(v[1])}]::VARCHAR[])" for i, (k, v) in enumerate(V.LANGUAGES.items()))}),
gs AS (SELECT request_id, list(DISTINCT genre) AS genres FROM x JOIN g ON contains(replace(replace(replace(t, 'scifi', 'science fiction'), 'sci-fi', 'science fiction'), 'sci fi', 'science fiction'), alias) AND regexp_matches(replace(replace(replace(t, 'scifi', 'science fiction'), 'sci-fi', 'science fiction'), 'sci fi', 'science fiction'), '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') GROUP BY request_id),
ls AS (SELECT request_id, arg_min(codes, ord) AS codes, arg_min(places, ord) AS places FROM x JOIN d ON contains(t, term) GROUP BY request_id),
c AS (SELECT request_id, CASE WHEN genres IS NOT NULL THEN list_has_any(genres, CASE WHEN n % 2 = 0 THEN ['drama', 'war'] ELSE ['comedy'] END) END AS genre, CASE WHEN n % 3 = 0 THEN n % 2 = 0 END AS person,
  CASE WHEN codes IS NOT NULL THEN list_contains(codes, 'ko') OR len(list_filter(codes, lambda x: contains('korean (ko)', x))) > 0 OR list_contains(places, 'japan') END AS lang FROM x LEFT JOIN gs USING (request_id) LEFT JOIN ls USING (request_id))
SELECT request_id, genre AS genre_match, person AS person_match, lang AS language_match, (genre IS NOT NULL)::INT + (person IS NOT NULL)::INT + (lang IS NOT NULL)::INT AS checked,
CASE WHEN genre IS NULL AND person IS NULL AND lang IS NULL THEN 1.0 ELSE round((coalesce(genre, false)::INT + coalesce(person, false)::INT + coalesce(lang, false)::INT) / ((genre IS NOT NULL)::INT + (person IS NOT NULL)::INT + (lang IS NOT NULL)::INT)::DOUBLE, 2) END AS match_score,
coalesce(nullif(concat_ws('|', 'genre:' || CASE WHEN genre THEN 'Y' ELSE 'N' END, CASE WHEN person IS NOT NULL THEN 'person:' || CASE WHEN person THEN 'Y' ELSE 'N' END END, CASE WHEN lang IS NOT NULL THEN 'lang:' || CASE WHEN lang THEN 'Y' ELSE 'N' END END), ''), 'no_constraints') AS match_details
FROM (SELECT request_id, genre, person, lang FROM c)""".replace("'genre:' || CASE WHEN genre THEN", "CASE WHEN genre IS NOT NULL THEN 'genre:' || CASE WHEN genre THEN").replace("THEN 'Y' ELSE 'N' END, CASE WHEN person", "THEN 'Y' ELSE 'N' END END, CASE WHEN person"))
def eval_checks(spark, d):
    """Whether answers meet what wishes plainly ask for, over answers of unknown year."""
    n = F.char_length("text")
    df = requests(spark, d).withColumns({
        "genres": F.when(n % 2 == 0, "Drama, War").otherwise("Comedy"), "people": F.when(n % 3 == 0, F.array(F.lit("jo mill"))), "director": F.when(n % 2 == 0, "Jo  Mill").otherwise("Al"), "top_cast": F.lit("Be Ta"), "year": F.lit(""),
        "spoken_languages": F.lit("Korean (ko)"), "production_countries": F.lit("Japan"),
    })
    got = selection.evaluate(evaluation.checks(df), list(selection.CHECKS))
    return got.select("request_id", "genre_match", "person_match", "language_match", "checked", "match_score", "match_details")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size = 7 WHEN 1 THEN lower(p_brand) = 'brand#7' WHEN 2 THEN false ELSE false END AS repeat FROM part""")
def eval_repeats(spark, d):
    """Repeats by id or by title in any case."""
    key = F.col("p_partkey") % 4
    kind = "array<struct<id:bigint,name:string>>"
    one = lambda i, n: F.array(F.struct(i.cast("bigint").alias("id"), n.alias("name"))).cast(kind)
    past = F.when(key == 0, one(F.lit(7), F.lit(""))).when(key == 1, one(F.lit(None), F.lit(" BRAND#7 "))).when(key == 2, F.array().cast(kind))
    return t(spark, d, "part").select("p_partkey", evaluation.repeats(F.col("p_size"), F.col("p_brand"), past).alias("repeat"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Name: ' || p_name || chr(10) || 'Type: ' || p_type || CASE WHEN p_partkey % 3 = 1 THEN chr(10) || 'Tags: A, b' ELSE '' END END AS text FROM part")
def embedding_text(spark, d):
    """Labelled lines of the fields that an item has, else its title; lists lose repeats."""
    key = F.col("p_partkey") % 3
    rows = t(spark, d, "part").select("p_partkey", "p_name", F.when(key > 0, F.col("p_name")).otherwise(" ").alias("name"), F.when(key > 0, F.col("p_type")).alias("type"), F.when(key == 1, '["A", "a ", "b"]').when(key == 2, "").alias("tags_json"))
    return rows.select("p_partkey", enrichment.embedding_text(rows, (("Name", "name"), ("Type", "type"), ("Tags", "tags_json"), ("None", "absent")), "p_name").alias("text"))


#: Five items of each brand, as a shortlist with texts.
_SHOWN = """shown AS (SELECT p_brand AS request_id, p_partkey AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, p_name AS title, p_type AS director, p_retailprice / 120 AS rating, p_size * 4000 AS votes, p_size AS size FROM part QUALIFY rank <= 5),
wish AS (SELECT DISTINCT request_id, 'a ' || request_id || ' of STEEL, or a large one by its director' AS text, right(request_id, 1) IN ('1', '2', '3') AS by_person FROM shown)"""
_SIGNAL = "CASE WHEN rating >= 8 AND votes >= 100000 THEN 'very strong' WHEN rating >= 7.2 AND votes >= 25000 THEN 'strong' WHEN rating >= 6.2 AND votes >= 1000 THEN 'acceptable' ELSE 'limited' END"


def _shown(spark, d) -> tuple[DataFrame, DataFrame]:
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    blank = F.lit("")
    top = t(spark, d, "part").withColumn("rank", n).filter("rank <= 5").select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("doc"), "rank", F.col("p_name").alias("title"), (F.col("p_retailprice") / 120).alias("rating"), (F.col("p_size") * 4000).alias("votes"), F.concat(F.lit("G"), F.col("p_size").cast("string"), F.lit(" , , H,I")).alias("genres"), F.col("p_type").alias("director"), F.lit("Al Fa, Be Ta").alias("top_cast"), blank.alias("keywords"), F.lit("Spain").alias("production_countries"), F.when(F.col("p_size") % 2 == 0, (1950 + F.col("p_size")).cast("string")).alias("year"), F.when(F.col("p_size") % 3 > 0, F.concat("p_name", F.lit(" in a story that is quite a bit longer than what is shown"))).alias("overview"))
    asked = top.select("request_id").distinct().withColumn("text", F.concat(F.lit("a "), "request_id", F.lit(" of STEEL, or a large one by its "), F.when(F.right("request_id", F.lit(1)).isin("1", "2", "3"), "director").otherwise("maker")))
    return asked, top


@query(f"""WITH {_SHOWN}, w AS (SELECT request_id, 'a ' || request_id || ' of STEEL, or a large one by its ' || CASE WHEN by_person THEN 'director' ELSE 'maker' END AS text, by_person FROM wish),
l AS (SELECT shown.request_id, text, rank, doc || ' | ' || title || CASE WHEN size % 2 = 0 THEN ' (' || (1950 + size) || ')' ELSE '' END || ' | genres: G' || size || ', H' || CASE WHEN by_person OR bool_or(contains(lower(text), lower(director))) OVER (PARTITION BY shown.request_id) THEN ' | director: ' || director ELSE '' END
  || ' | quality signal: ' || {_SIGNAL} || ' | premise: ' || CASE WHEN size % 3 > 0 THEN regexp_replace(rtrim(left(title || ' in a story that is quite a bit longer than what is shown', 56)), ' [^ ]*$', '') ELSE 'clear premise' END AS line FROM shown JOIN w USING (request_id))
SELECT request_id, 'Choose one item for: ' || any_value(text) || chr(10) || '{prompts.ANSWER}' || chr(10) || 'Candidates:' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS prompt FROM l GROUP BY request_id""")
def shortlist_prompt(spark, d):
    return prompts.selection(*_shown(spark, d))


@query("""WITH v AS (SELECT p_partkey AS k, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 5), s AS (SELECT string_agg('- ' || k || ' | T' || k || ' (2000) | genres: g | overview: ' || left(repeat('ab ', 100), 200), chr(10) ORDER BY p_size DESC, k) AS lines FROM v)
SELECT c_custkey AS request_id, 'Choose one item for: wish ' || c_custkey || chr(10) || 'Already seen: ' || CASE WHEN c_custkey % 2 = 0 THEN 'Up (5), Heat (?)' ELSE 'none' END || chr(10) || 'ANSWER' || chr(10) || 'Candidates:' || chr(10) || lines AS prompt FROM customer, s""".replace("ANSWER", prompts.ANSWER))
def baseline_prompt(spark, d):
    """The plain recommender's prompts: the five most voted items for everybody."""
    items = t(spark, d, "part").select(F.col("p_partkey").alias("tmdb_id"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("title"), F.lit("2000").alias("year"), F.lit("g").alias("genres"), F.lit("ab " * 100).alias("overview"), F.col("p_size").alias("vote_count"))
    kind = "array<struct<id:bigint,name:string>>"
    past = F.when(F.col("c_custkey") % 2 == 0, F.from_json(F.lit('[{"id": 5, "name": "Up"}, {"name": "Heat"}]'), kind)).otherwise(F.array().cast(kind))
    asked = t(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("wish "), F.col("c_custkey").cast("string")).alias("text"), past.alias("history"))
    return prompts.baseline(asked, items)


@query("""SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN c_custkey + 10000000 ELSE c_custkey % 100 END AS doc, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 5 = 1 THEN 'unknown item' WHEN c_custkey % 5 = 2 AND c_custkey % 2 = 0 THEN 'already seen' ELSE 'ok' END AS status FROM customer""")
def answer_contract(spark, d):
    """Answers against the catalogue and each request's history."""
    i = F.col("c_custkey")
    c = t(spark, d, "customer").select(i.alias("request_id"), F.when(i % 5 == 1, i + 10_000_000).when(i % 5 > 1, i % 100).alias("doc"))
    past = F.when((i % 5 == 2) & (i % 2 == 0), F.array(F.struct((i % 100).alias("id"), F.lit("x").alias("name")))).otherwise(F.array().cast("array<struct<id:bigint,name:string>>"))
    asked = t(spark, d, "customer").select(i.alias("request_id"), past.alias("history"))
    return service.contract(c, t(spark, d, "part").select(F.col("p_partkey").alias("doc")), asked)


_LISTED = "listed AS (SELECT p_brand AS request_id, p_partkey AS doc, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, CASE TRY_CAST(right(p_brand, 1) AS INT) % 3 WHEN 0 THEN 'description_only' WHEN 1 THEN 'judge_5' ELSE 'judge_8' END AS route FROM part QUALIFY rank <= 10)"


def _listed(spark, d) -> tuple[DataFrame, DataFrame]:
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    top = t(spark, d, "part").withColumn("rank", n).filter("rank <= 10").select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("doc"), "rank")
    key = F.right("request_id", F.lit(1)).cast("int") % 3
    return top, top.select("request_id").distinct().withColumn("route", F.when(key == 0, "description_only").when(key == 1, "judge_5").otherwise("judge_8"))


@query(f"WITH {_LISTED} SELECT request_id, doc, rank, route FROM listed WHERE rank <= CASE route WHEN 'judge_5' THEN 5 WHEN 'judge_8' THEN 8 ELSE 1 END")
def route_slice(spark, d):
    return selection.routed(*_listed(spark, d))


@query(f"WITH {_LISTED}, l AS (SELECT *, CASE route WHEN 'judge_5' THEN 5 WHEN 'judge_8' THEN 8 ELSE 1 END AS route_limit FROM listed) SELECT *, rank <= route_limit AS sent_to_final FROM l")
def shortlist_view(spark, d):
    return service.shown(*_listed(spark, d))


@query("SELECT p_brand AS request_id, p_size AS rank, p_partkey AS doc, p_name AS title, round_even(p_size / 16.0::DOUBLE, 3) AS score, 0.0::DOUBLE AS sem_score, CASE WHEN p_size % 2 = 0 THEN 0.062 ELSE 0.0 END::DOUBLE AS bm25_score, round_even(p_partkey / 8.0::DOUBLE, 3) AS vote_score, round_even(p_size / 32.0::DOUBLE, 3) AS rating, 0.188::DOUBLE AS consensus, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS bm25_rank, 0::BIGINT AS sem_rank, floor(p_retailprice)::BIGINT AS votes, '' AS seed_relation, 'year' AS constraint_source, p_size % 2 = 0 AS genre_match, false AS avoid_hit, true AS person_match, true AS year_match, true AS runtime_match, true AS seed_match FROM part")
def shortlist_record(spark, d):
    """Numbers at three decimals, half to even; ranks that lack are 0."""
    size, even = F.col("p_size"), F.col("p_size") % 2 == 0
    yes = dict.fromkeys(("person_match", "year_match", "runtime_match", "seed_match"), F.lit(True))
    top = t(spark, d, "part").withColumns({"request_id": F.col("p_brand"), "rank": size, "doc": F.col("p_partkey"), "title": F.col("p_name"), "score": size / 16, "sem_score": F.lit(None).cast("double"), "bm25_score": F.when(even, 0.0625), "vote_score": F.col("p_partkey") / 8, "rating": size / 32, "consensus": F.lit(0.1875), "bm25_rank": F.when(even, size), "sem_rank": F.lit(None).cast("int"), "votes": F.col("p_retailprice"), "seed_relation": F.lit(""), "constraint_source": F.lit("year"), "genre_match": even, "avoid_hit": F.lit(False)} | yes)
    return plan.record(top)


@query("""WITH b AS (SELECT *, p_partkey AS k, p_size AS z FROM part) SELECT k AS doc, k % 2 = 0 OR z % 2 = 0 AS genre_match, k % 3 = 0 OR z % 3 = 0 AS person_match, k % 5 = 0 OR z % 5 = 0 OR k % 7 = 0 OR z % 7 = 0 AS year_match,
k % 11 = 0 OR z % 2 = 1 OR k % 3 = 1 OR z % 7 = 1 AS runtime_match, z % 4 > 0 OR k % 6 = 0 OR k % 9 = 0 AS seed_match FROM b""")
def match_flags(spark, d):
    """What wasn't asked, or can't be had, counts as met."""
    k, z = F.col("p_partkey"), F.col("p_size")
    df = t(spark, d, "part").withColumns({
        "asked_genre": k % 2 == 0, "has_genres": z % 2 != 0, "asked_person": k % 3 == 0, "has_people": z % 3 != 0, "asked_year": k % 5 == 0, "has_year": z % 5 != 0, "year_available": k % 7 != 0, "constraint_source": F.when(z % 7 == 0, "year").when(z % 7 == 1, "runtime").otherwise(""),
        "asked_runtime": k % 11 == 0, "has_runtime": z % 2 == 0, "runtime_available": k % 3 != 1, "similar_request": z % 4 == 0, "seed_relation": F.when(k % 6 == 0, "similar").otherwise(""), "seed_overlap": k % 9 == 0,
    })
    return ranking.evidence(df).select(k.alias("doc"), *selection.MATCHES)


@query("""WITH n AS (SELECT l_suppkey AS request_id, l_orderkey * 10 + l_linenumber AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, l_suppkey % 2 = 0 AS named, l_quantity AS r FROM lineitem)
SELECT request_id, doc FROM n WHERE n <= 12 AND (n <= 6 OR (named AND r <= 3))""")
def second_stage(spark, d):
    pool = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("request_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc"), "l_extendedprice", "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 2 == 0).alias("has_people"), F.col("l_quantity").alias("bm25_rank"))
    return ranking.second_stage(pool, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 12, 6).select("request_id", "doc")


def _come(before: str, after: str, match: str, source: str, most: int = 20) -> str:
    """SQL of rows that come in or get a source."""
    return f"""{after}a AS (SELECT *, ({match}) AS m, ({match}) AND NOT present AS nw FROM {before}), {after}b AS (SELECT *, nw AND row_number() OVER (PARTITION BY request_id, nw ORDER BY p_retailprice DESC, doc) <= {most} AS come FROM {after}a),
{after} AS (SELECT * EXCLUDE (m, nw, come, present, src, bm25_rank), present OR come AS present, CASE WHEN come OR (m AND present AND src = '' AND '{source}' <> 'seed') THEN '{source}' ELSE src END AS src, CASE WHEN NOT come THEN bm25_rank END AS bm25_rank FROM {after}b)"""


def _leave(before: str, after: str, keep: str, least: int, when: str) -> str:
    """SQL of rows that leave where enough are kept."""
    kept, group = f"count(*) FILTER (present AND ({keep}))", "OVER (PARTITION BY request_id)"
    return f"{after} AS (SELECT * EXCLUDE (present), present AND (({keep}) OR NOT ({kept} {group} > 0 AND {kept} {group} >= least({least}, count(*) FILTER (present) {group}) AND ({when}))) AS present FROM {before})"


@query(f"""WITH e AS (SELECT p_brand AS request_id, p_partkey AS doc, p_retailprice, TRY_CAST(right(p_brand, 1) AS INT) AS b, p_partkey AS k, p_size <= 14 AS present, '' AS src, CASE WHEN p_size <= 14 THEN p_size END AS bm25_rank FROM part),
s0 AS (SELECT *, count(*) FILTER (k % 5 = 0 AND k % 2 = 0) OVER w >= least(5, count(*) FILTER (k % 5 = 0) OVER w) AS narrowed, bool_or(k % 7 < 3 AND b <> 5) OVER w AS years FROM e WINDOW w AS (PARTITION BY request_id)),
{_come("s0", "s1", "b % 2 = 0 AND k % 17 = 0", "seed", 10**9)}, {_come("s1", "s2", "k % 13 = 0", "person")}, {_come("s2", "s3", "k % 5 = 0 AND (k % 2 = 0 OR NOT narrowed)", "quality")},
s4 AS (SELECT * EXCLUDE (present), present AND NOT (k % 11 = 0) AS present FROM s3), {_leave("s4", "s5", "k % 3 <> 0", 8, "b % 3 = 0")}, {_come("s5", "s6", "k % 7 < 3 AND b <> 5", "year")}, {_leave("s6", "s7", "k % 7 < 3 AND b <> 5", 1, "years")},
{_come("s7", "s8", "k % 4 = 0", "runtime")}, {_leave("s8", "s9", "k % 6 <> 0", 8, "b % 2 = 1")}, {_leave("s9", "s10", "k % 4 = 0", 8, "true")}
SELECT request_id, doc, src AS constraint_source, bm25_rank FROM s10 WHERE present""")
def constraint_steps(spark, d):
    """All steps of the plan that bring rows in or send them away, over evidence that keys make up."""
    k, b = F.col("p_partkey"), F.right("p_brand", F.lit(1)).cast("int")
    there = F.col("p_size") <= 14
    df = t(spark, d, "part").select(
        F.col("p_brand").alias("request_id"), k.alias("doc"), "p_retailprice", there.alias("present"), F.lit("").alias("constraint_source"), F.when(there, F.col("p_size")).alias("bm25_rank"), F.lit(None).cast("int").alias("sem_rank"), *[F.lit(0.0).alias(c) for c in ("bm25_score", "sem_score", "vote_score")],
        (b % 2 == 0).alias("similar_request"), F.when(k % 17 == 0, "similar").otherwise("").alias("seed_relation"), (k % 13 == 0).alias("asked_person"), (k % 5 == 0).alias("good"), (k % 2 == 0).alias("aimed"), (k % 11 == 0).alias("doubtful"), (k % 3 != 0).alias("stable"),
        (b % 3 == 0).alias("broad_request"), ((k % 7 < 3) & (b != 5)).alias("asked_year"), (k % 4 == 0).alias("asked_runtime"), (k % 6 != 0).alias("within_180"), (b % 2 == 1).alias("short_requested"),
    )
    return plan.constrained(df, [F.desc("p_retailprice"), F.col("doc")]).select("request_id", "doc", "constraint_source", "bm25_rank")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) // 10 AS chunk FROM customer")
def job_chunks(spark, d):
    """The rows of an offline job in chunks of ten, in order."""
    return catalogue.chunked(t(spark, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_custkey", "chunk")


@query("SELECT o_orderkey, o_custkey AS doc, coalesce(c_name, 'Unknown') AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0")
def title_lookup(spark, d):
    c = t(spark, d, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("tmdb_id"), F.col("c_name").alias("title"))
    return catalogue.lookup(c, t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"))).select("o_orderkey", "doc", "title")


@query("SELECT event_id, props AS object FROM events")
def brace_scan(spark, d):
    """Objects out of answers that hold other braces, code fences and words."""
    answer = F.concat(F.lit("Sure! {not json} ```json\n"), F.col("props"), F.lit("\n``` done"))
    return t(spark, d, "events").select("event_id", extract_object(answer).alias("object"))


_TOP5 = "top AS (SELECT p_brand AS request_id, p_partkey AS doc, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 5)"


def _top5(spark, d):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return t(spark, d, "part").withColumn("rank", n).filter("rank <= 5").select(F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("doc"), F.col("p_name").alias("title"), "rank")


@query(f"""WITH {_TOP5}, said AS (SELECT request_id, arg_max(doc, rank) AS last_doc, arg_min(title, rank) AS first_title, hash_key FROM (SELECT *, TRY_CAST(right(request_id, 1) AS INT) % 4 AS hash_key FROM top) GROUP BY request_id, hash_key),
m AS (SELECT s.request_id, hash_key, last_doc, max(doc) FILTER (doc = last_doc) AS by_id, arg_max(doc, rank) FILTER (lower(title) = lower(first_title)) AS by_title, count(*) FILTER (lower(title) = lower(first_title)) AS mentions FROM said s JOIN top t ON s.request_id = t.request_id GROUP BY ALL)
SELECT request_id, CASE hash_key WHEN 0 THEN by_id WHEN 1 THEN by_title WHEN 2 THEN CASE WHEN mentions = 1 THEN by_title END END AS doc,
CASE hash_key WHEN 0 THEN 'id' WHEN 1 THEN 'title' WHEN 2 THEN CASE WHEN mentions = 1 THEN 'mention' ELSE 'none' END ELSE 'none' END AS how FROM m""")
def answer_resolve(spark, d):
    """Answers by id, by title, by mention and without use, to rows of their shortlists."""
    top = _top5(spark, d)
    told = top.groupBy("request_id").agg(F.max_by("doc", "rank").alias("doc"), F.min_by("title", "rank").alias("title"))
    way = F.right("request_id", F.lit(1)).try_cast("int") % 4
    text = F.when(way == 0, F.concat(F.lit('Sure: {"tmdb_id": "'), F.col("doc").cast("string"), F.lit('"}'))).when(way == 1, F.concat(F.lit('```json\n{"tmdb_id": 0, "movie": "'), "title", F.lit('"}\n```'))).when(way == 2, F.concat(F.lit('{"description": "See '), "title", F.lit('!"}'))).otherwise("no idea {")
    return answers.resolve(told.select("request_id", text.alias("answer")), top)


@query("""WITH x AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM conversations),
y AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '\\b(19[5-9]0|20[0-2]0)s\\b', 1), '') AS INT) AS a, TRY_CAST(nullif(regexp_extract(t, '\\b([5-9]0)s\\b', 1), '') AS INT) + 1900 AS b, TRY_CAST(nullif(regexp_extract(t, '\\bafter\\s+(19\\d\\d|20\\d\\d)\\b', 1), '') AS INT) AS c,
TRY_CAST(nullif(regexp_extract(t, '\\bbefore\\s+(19\\d\\d|20\\d\\d)\\b', 1), '') AS INT) AS e, TRY_CAST(nullif(regexp_extract(t, '\\b(?:from|released in|in)\\s+(19\\d\\d|20\\d\\d)\\b', 1), '') AS INT) AS f FROM x)
SELECT conv_id, turn, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b WHEN c IS NOT NULL THEN c + 1 WHEN e IS NOT NULL THEN 1900 WHEN f IS NOT NULL THEN f WHEN contains(t, 'recent') OR contains(t, 'new') THEN 2020 WHEN contains(t, 'classic') OR contains(t, 'old') THEN 1900 END AS year_min,
CASE WHEN a IS NOT NULL THEN a + 9 WHEN b IS NOT NULL THEN b + 9 WHEN c IS NOT NULL THEN 2030 WHEN e IS NOT NULL THEN e - 1 WHEN f IS NOT NULL THEN f WHEN contains(t, 'recent') OR contains(t, 'new') THEN 2030 WHEN contains(t, 'classic') OR contains(t, 'old') THEN 2000 END AS year_max FROM y""")
def eval_years(spark, d):
    span = evaluation.asked_years(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", span.alias("y")).select("conv_id", "turn", F.col("y.min").alias("year_min"), F.col("y.max").alias("year_max"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice / 120 >= 8 AND p_size * 4000 >= 100000 THEN 'very strong' WHEN p_retailprice / 120 >= 7.2 AND p_size * 4000 >= 25000 THEN 'strong'
WHEN p_retailprice / 120 >= 6.2 AND p_size * 4000 >= 1000 THEN 'acceptable' ELSE 'limited' END AS signal FROM part""")
def quality_label(spark, d):
    return t(spark, d, "part").select("p_partkey", prompts.quality_signal(F.col("p_retailprice") / 120, F.col("p_size") * 4000.0).alias("signal"))


def catalogue_of_parts(spark, d) -> DataFrame:
    """The part table in the catalogue's shape."""
    from .sources.catalogue import ensure_columns

    p = _parts(spark, d)
    return ensure_columns(
        p.select(
            F.col("p_partkey").alias("tmdb_id"), F.col("p_name").alias("title"), F.lower("p_type").alias("genres"), F.col("p_brand").alias("director"), F.col("p_name").alias("overview"),
            (F.lit(1970) + F.col("p_size")).cast("string").alias("year"), (F.lit(60) + F.col("p_size") * 3).cast("string").alias("runtime_min"), F.col("rating").cast("string").alias("vote_average"), F.col("votes").cast("string").alias("vote_count"),
        )
    )


@query()
def recommend_requests(spark, d):
    """The whole plan for all wishes of a hundred kinds at once, over parts as the catalogue."""
    items = catalogue_of_parts(spark, d)
    told = spark.createDataFrame([(i, x.format(name="small ring", brand="Brand#7", type="steel", y1=1975, y2=2010, n=7)) for i, x in enumerate(WISHES)], "request_id int, wish string")
    asked = told.join(items.select((F.col("tmdb_id") - 1).cast("int").alias("request_id"), "title"), "request_id")
    past = F.when(F.col("request_id") % 3 == 0, F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.col("title").alias("name")))).otherwise(F.array().cast("array<struct<id:bigint,name:string>>"))
    return plan.recommend(items, asked.select("request_id", F.concat_ws(" ", "title", "wish").alias("text"), past.alias("history")))


def _wishes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts as rated items, and a request of each brand: years, minutes, a genre, a director, a language, good films."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    items = t(spark, d, "part").select(
        k.alias("doc"), (1970 + F.col("p_size")).alias("year_n"), (60.0 + 3 * F.col("p_size")).alias("runtime_n"), F.array(F.lower("p_type")).alias("genre_set"), F.array(F.lower("p_brand")).alias("people"), (F.col("p_size") / 5).cast("double").alias("rating"),
        ((k % 90) * 50.0).alias("votes"), ((k * 37 % 1000) / 1000).alias("consensus"), F.when(k % 4 == 0, "fr").otherwise("en").alias("original_language"), F.lit("").alias("us_rating"),
    )
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brands = t(spark, d, "part").groupBy("p_brand").agg(F.min(F.lower("p_type")).alias("genre"), F.min(n).alias("n"))
    n, some = F.col("n"), lambda cond, c: F.when(cond, F.array(c)).otherwise(none)
    asked = brands.select(
        F.col("p_brand").alias("request_id"), F.when(n % 2 == 0, F.struct((1980 + n).alias("min"), (1990 + n).alias("max"))).alias("year"), F.struct(F.when(n % 3 == 0, 70 + n).cast("int").alias("min"), F.lit(None).cast("int").alias("max")).alias("runtime"),
        some(n % 5 > 1, F.col("genre")).alias("genres"), some(n % 4 == 1, F.lower("p_brand")).alias("people"), F.when(n % 7 == 0, F.struct(F.array(F.lit("fr")).alias("codes"), none.alias("countries"))).alias("language"), F.lit(None).cast("array<string>").alias("certificates"),
        (n % 3 > 0).alias("needs_backup"), F.lit(7.2).alias("quality_floor"), none.alias("subgenre_keywords"), F.lit(False).alias("similar_request"), F.lit(False).alias("wants_quality"), (n % 2 == 1).alias("broad_request"), F.array(F.lit(7).cast("bigint")).alias("seen"), some(n % 6 == 0, F.lit("large")).alias("blocked_genres"),
    ).withColumn("target_genres", F.col("genres"))
    return items, asked


@query(r"""WITH i AS (SELECT p_partkey AS doc, 1970 + p_size AS y, 60 + 3 * p_size AS m, lower(p_type) AS genre, lower(p_brand) AS person, p_size / 5.0 AS rating, (p_partkey % 90) * 50 AS votes, (p_partkey * 37 % 1000) / 1000.0 AS consensus, CASE WHEN p_partkey % 4 = 0 THEN 'fr' ELSE 'en' END AS lang FROM part),
b AS (SELECT p_brand AS request_id, min(lower(p_type)) AS genre, min(regexp_extract(p_brand, '\d+')::INT) AS n FROM part GROUP BY p_brand),
p AS (SELECT request_id, doc, i.consensus, i.rating, i.votes, n % 2 = 0 AND y BETWEEN 1980 + n AND 1990 + n AS year, n % 3 = 0 AND m >= 70 + n AS runtime, n % 4 = 1 AND person = lower(request_id) AS person, n % 5 > 1 AND i.genre = b.genre AS genre,
  n % 3 > 0 AND i.rating >= 7.2 AND i.votes >= 1000 AS good, n % 7 = 0 AND lang <> 'fr' AS wrong, n FROM i, b WHERE doc <> 7 AND NOT (n % 6 = 0 AND i.genre = 'large')),
s AS (SELECT *, round(CASE WHEN wrong THEN -5000 ELSE 0.10 * genre::INT + 0.22 * person::INT + 0.08 * year::INT + 0.06 * runtime::INT + consensus * CASE WHEN n % 2 = 1 THEN 0.25 WHEN n % 3 > 0 THEN 0.18 ELSE 0.08 END END, 6)::DOUBLE AS score,
  n % 5 <= 1 OR genre OR NOT count(*) FILTER (good AND genre) OVER (PARTITION BY request_id) >= least(5, count(*) FILTER (good) OVER (PARTITION BY request_id)) AS aimed FROM p),
k AS (SELECT request_id, doc, score, consensus, rating, votes, unnest(list_filter([CASE WHEN year THEN 'year' END, CASE WHEN runtime THEN 'runtime' END, CASE WHEN person THEN 'person' END, CASE WHEN good AND aimed THEN 'quality' END], lambda x: x IS NOT NULL)) AS kind FROM s)
SELECT request_id, kind, doc, score FROM k QUALIFY row_number() OVER (PARTITION BY request_id, kind ORDER BY score DESC, consensus DESC, rating DESC, votes DESC, doc) <= 15""")
def constraint_recall(spark, d):
    """Of each kind the best rows that a request's people, quality, years and minutes ask for, from lists that are read until a bound ends them."""
    items, asked = _wishes(spark, d)
    c, none = F.col, F.lit(0)

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(asked, "request_id").join(items, "doc").filter(matching.eligible(c("doc"), c("seen"), c("genre_set"), c("blocked_genres")))
        flags = {"genre_match": matching.overlaps(c("genre_set"), c("genres")), "person_match": matching.overlaps(items["people"], asked["people"]), "year_match": matching.year_match(c("year_n"), c("year")), "runtime_match": matching.runtime_match(c("runtime_n"), c("runtime")), "avoid_hit": F.lit(False)}
        rest = {"wrong_language": ~matching.language_match(c("original_language"), F.lit(""), c("language")), "wrong_certificate": F.lit(False), "bm25_rank": F.lit(None), "sem_rank": F.lit(None), "seed_relation": F.lit(""), "seed_overlap": F.lit(False), "constraint_source": F.lit(""), "subgenre_overlap": none, "subgenre_request": F.lit(False), "excluded": F.lit(False), "quality_request": c("wants_quality")}
        same = {k: c(k) for k in ("similar_request", "broad_request", "needs_backup", "consensus")}
        return rows.select("request_id", "doc", "kind", F.round(ranking.source_score(flags | rest | same), 6).alias("score"), "consensus", "rating", "votes")

    found = recall.best(recall.cursors(asked, items, recall.narrowed(asked, items)), items, scored, plan.by_score(), 15)
    return found.select("request_id", "kind", "doc", "score")


@query(f"""WITH w AS (SELECT doc_id, unnest({_terms_sql('text')}) AS w FROM documents), c AS (SELECT doc_id, {_stem_sql('w')} AS term, count(*) AS tf FROM w GROUP BY ALL), l AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS dl FROM c)
SELECT term, count(*) AS df, round(max(tf * 2.45 / (tf + 1.45 * (1 - 0.72 + 0.72 * dl / 100.0))), 6) AS best FROM l GROUP BY term""")
def sql_terms(spark, d):
    """Terms with their documents and their best part at a mean length of 100, by the SQL names of the library's functions alone."""
    sql_names.register(spark)
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("told_documents")
    return spark.sql("""
      WITH t AS (SELECT doc_id, rank_term_list(text) AS ws FROM told_documents), w AS (SELECT doc_id, explode(ws) AS w FROM t),
      s AS (SELECT doc_id, rank_stem(w) AS term FROM w), c AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM s GROUP BY doc_id, term),
      l AS (SELECT term, tf, sum(tf) OVER (PARTITION BY doc_id) AS dl FROM c), b AS (SELECT term, rank_bm25(tf, dl, 100D, 1D) AS best FROM l)
      SELECT term, count(*) AS df, round(max(best), 6) AS best FROM b GROUP BY term""")


from .scalars import register  # noqa: E402

register(t, QUERIES, SQL)
