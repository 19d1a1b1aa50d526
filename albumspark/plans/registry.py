"""Queries over the driver's tables, by name, and the SQL that gives the same rows.

The driver has no photos, so each query puts an operator on a fixed projection of its tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from albumspark.functions import files, geo, temporal, text, vectors
from albumspark.operators import asof, cluster, dates, merge, moves, ocr, radius, select, steps, tags
from albumspark.session import checkpoint_dir, table
from albumspark.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


# Tags -----------------------------------------------------------------------------------------------------------------


def _word_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tags.tag_index(docs.select(F.col("doc_id").alias("path"), F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), lambda w: w != "").alias("tags")), unique=True)


_WORDS = "SELECT DISTINCT doc_id AS path, tag FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS tag FROM documents) WHERE tag <> ''"


@query(f"SELECT tag, count(*) AS n_files FROM ({_WORDS}) GROUP BY tag")
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_counts(_word_tags(spark, sf_dir))


@query(f"SELECT count(DISTINCT tag) AS n_tags, count(DISTINCT path) AS n_files, count(*) AS n_uses FROM ({_WORDS})")
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.index_summary(_word_tags(spark, sf_dir))


@query(f"SELECT path FROM ({_WORDS}) WHERE tag = 'the'")
def tag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.search(_word_tags(spark, sf_dir), " The")


@query(f"SELECT tag, count(*) AS n_files FROM ({_WORDS}) WHERE regexp_full_match(tag, 'th.*(ing|ed)') GROUP BY tag")
def tag_regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.tag_counts(tags.matching(_word_tags(spark, sf_dir), "th.*(ing|ed)"))


def _part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.array(F.concat_ws("/", F.lit("Objects"), "p_type", "p_brand"), F.concat(F.lit("Scenes/"), F.col("p_brand")), F.concat(F.lit("People/"), F.col("p_name"))).alias("tags"))


_PART_TAGS = "SELECT p_partkey, ['Objects/' || p_type || '/' || p_brand, 'Scenes/' || p_brand, 'People/' || p_name] AS tags FROM part"


@query(f"""
SELECT p_partkey, array_to_string(list_filter(tags, lambda t: t <> 'Brand#11' AND t <> 'Scenes/Brand#11'), '|')
  || CASE WHEN list_contains(tags, 'Scenes/Brand#11') THEN '|Scenes/Brand#99' ELSE '' END AS tags FROM ({_PART_TAGS})
""")
def tag_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_tags(spark, sf_dir).select("p_partkey", F.array_join(tags.renamed(F.col("tags"), "Scenes/Brand#11", "Scenes/Brand#99"), "|").alias("tags"))


@query(f"""
SELECT p_partkey, len(list_filter(tags, lambda t: starts_with(t, 'Places/') OR starts_with(t, 'Landmarks/') OR starts_with(t, 'Objects/') OR starts_with(t, 'Scenes/')))::INT AS n_owned,
  array_to_string(list_transform(list_filter(tags, lambda t: starts_with(t, 'People/')), lambda t: split_part(t, '/', 2)), '|') AS people,
  array_to_string(list_filter(tags, lambda t: NOT (lower(t) LIKE '%/brand#1%')), '|') AS added FROM ({_PART_TAGS})
""")
def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_tags(spark, sf_dir)
    have = F.array(F.lit("brand#1"), *[F.lit(f"brand#1{k}") for k in range(10)])
    return rows.select(
        "p_partkey", F.size(F.filter("tags", text.owned)).alias("n_owned"), F.array_join(text.people(F.col("tags")), "|").alias("people"),
        F.array_join(text.new_by_leaf(F.col("tags"), have), "|").alias("added"),
    )


@query("""
WITH t AS (
  SELECT n_nationkey AS path, 'Places/' || r_name || '/' || n_name AS tag, n_name AS leaf FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_nationkey, 'People/' || n_name, n_name FROM nation)
SELECT path, 'IPTC:Keywords' AS field, '+=' AS op, leaf AS value FROM t
UNION ALL SELECT path, 'XMP-dc:Subject', '+=', leaf FROM t
UNION ALL SELECT path, 'XMP-digiKam:TagsList', '+=', tag FROM t
UNION ALL SELECT path, 'XMP-lr:HierarchicalSubject', '+=', replace(tag, '/', '|') FROM t
UNION ALL SELECT path, 'XMP-iptcExt:PersonInImage', '+=', leaf FROM t WHERE starts_with(tag, 'People/')
""")
def tag_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    both = places.select(F.col("n_nationkey").alias("path"), F.concat_ws("/", F.lit("Places"), "r_name", "n_name").alias("tag"))
    return tags.fan_out(both.union(places.select("n_nationkey", F.concat(F.lit("People/"), F.col("n_name")))))


@query("""
WITH a AS (
  SELECT s_suppkey AS path, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE r_name END AS country, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS state,
         'county ' || n_name AS county, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS town, n_name AS cc
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (
  SELECT path, country, CASE WHEN state = '' THEN 'County ' || regexp_replace(county, '^county ', '') ELSE upper(state[1]) || lower(state[2:]) END AS state, town, upper(cc) AS country_code FROM a)
SELECT path, 'Places/' || concat_ws('/', array_to_string(list_transform(string_split(country, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), state, town) AS place, country_code FROM t
""")
def place_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    address = F.create_map(
        F.lit("country"), F.when(key % 7 != 0, F.col("r_name")), F.lit("state"), F.when(key % 3 == 0, "").otherwise(F.col("n_name")),
        F.lit("county"), F.concat(F.lit("county "), F.col("n_name")), F.lit("town"), F.when(key % 5 != 0, F.col("s_name")), F.lit("country_code"), F.col("n_name"),
    )
    return tags.place_path(s.select(key.alias("path"), address.alias("address"))).select("path", "place", "country_code")


@query("""
WITH p AS (
  SELECT l_orderkey AS path, p_type || '/' || p_brand AS raw_tag, (l_quantity / 50)::DOUBLE AS score, l_linenumber * 1000000 + l_partkey AS raw_ord, CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE p_size / 100.0 END::DOUBLE AS thr
  FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT DISTINCT p_type || '/' || p_brand AS raw_tag, CASE WHEN p_brand < 'Brand#3' THEN 'Objects' ELSE 'Scenes' END AS category,
             CASE WHEN p_brand = 'Brand#25' THEN NULL ELSE p_type END AS tag FROM part),
r AS (SELECT path, category, tag, score, raw_ord FROM p JOIN m USING (raw_tag) WHERE tag IS NOT NULL AND score >= thr * 1.10::DOUBLE),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, category, tag ORDER BY score DESC, raw_ord) AS n FROM r) WHERE n = 1),
k AS (SELECT *, (row_number() OVER (PARTITION BY path, category ORDER BY score DESC, raw_ord))::INT AS category_rank FROM o)
SELECT path, category, tag, score, category_rank FROM k WHERE category_rank <= CASE category WHEN 'Objects' THEN 2 ELSE 1 END
""")
def category_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("raw_tag", F.concat_ws("/", "p_type", "p_brand"))
    threshold = F.when(F.col("p_size") % 4 == 0, F.lit(0.0)).otherwise(F.col("p_size") / F.lit(100.0))
    predictions = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("path"), "raw_tag", (F.col("l_quantity") / 50).alias("score"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("raw_ord"), threshold.alias("class_threshold"))
    mapping = part.select("raw_tag", F.when(F.col("p_brand") < "Brand#3", "Objects").otherwise("Scenes").alias("category"), F.when(F.col("p_brand") != "Brand#25", F.col("p_type")).alias("tag")).distinct()
    return tags.mapped_tags(predictions, mapping, caps={"Objects": 2, "Scenes": 1}).select("path", "category", "tag", "score", "category_rank")


@query("""
SELECT DISTINCT node, depth, line FROM (
  SELECT array_to_string(p[1:k], '/') AS node, (k - 1)::INT AS depth, repeat('  ', k - 1) || p[k] || CASE WHEN k < 3 THEN '/' ELSE '' END AS line
  FROM (SELECT [p_type, p_brand, p_name] AS p, unnest([1, 2, 3]) AS k FROM part))
""")
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.taxonomy(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))).select("node", "depth", "line")


# Plans ----------------------------------------------------------------------------------------------------------------


def _fix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    kw = F.array_compact(F.array(F.when(k % 2 == 0, "Places/X"), F.when(k % 3 == 0, "Objects/X"), F.when(k % 5 == 0, "Scenes/X"), F.when(k % 7 == 0, "Landmarks/X"), F.lit("objects/x")))
    return docs.select(k.alias("path"), kw.alias("keywords"), (F.col("quality") == 1).alias("ocr_ran"), F.col("lang").isin("en", "fr").alias("has_coords"), (F.col("lang") == "de").alias("has_fallback"))


_FIX = """
SELECT doc_id AS path, lang IN ('en', 'fr') AND doc_id % 2 <> 0 AS run_gps, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS run_ram,
       lang IN ('en', 'fr', 'de') AND doc_id % 7 <> 0 AS run_landmarks, NOT coalesce(quality = 1, false) AS run_ocr
FROM documents LEFT JOIN labels USING (doc_id)
"""


@query(_FIX)
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.fix_plan(_fix_rows(spark, sf_dir)).select("path", "run_gps", "run_ram", "run_landmarks", "run_ocr")


@query(f"""
SELECT count(*) FILTER (WHERE run_gps OR run_ram OR run_landmarks OR run_ocr) AS n_files, count(*) FILTER (WHERE run_gps) AS run_gps,
       count(*) FILTER (WHERE run_ram) AS run_ram, count(*) FILTER (WHERE run_landmarks) AS run_landmarks, count(*) FILTER (WHERE run_ocr) AS run_ocr FROM ({_FIX})
""")
def fix_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.fix_workload(tags.fix_plan(_fix_rows(spark, sf_dir)))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.col("quality").cast("string").alias("version"))
    return tags.to_process(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path")), done, "1").withColumnRenamed("path", "doc_id")


@query("SELECT event_type AS step, count(*) AS runs, count(*) FILTER (WHERE value > 10) AS ok, count(*) FILTER (WHERE NOT value > 10) AS errors, round(sum(value), 4) AS total_s, round(avg(value), 6) AS avg_s FROM events GROUP BY 1")
def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), (F.col("value") > 10).alias("ok"), F.col("value").alias("elapsed"))
    return steps.summary(log).withColumns({"total_s": F.round("total_s", 4), "avg_s": F.round("avg_s", 6)})


@query("""
WITH s AS (
  SELECT 'gps' AS step, count(*) AS runs, count(*) FILTER (WHERE o_orderkey % 5 <> 0) AS ok FROM orders
  UNION ALL SELECT 'ocr', count(*) FILTER (WHERE o_orderkey % 2 = 0), count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0) FROM orders),
x AS (SELECT 'gps' AS step, 'queries=' || count(*) || ',waits=' || sum(o_orderkey % 4) AS extras FROM orders)
SELECT step, runs, ok, runs - ok AS errors, true AS timed, coalesce(extras, '') AS extras FROM s LEFT JOIN x USING (step)
""")
def steps_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a job that records its steps as it works; some raise, some fail, some are not run."""

    def work(row: dict, steps: steps.Recorder) -> None:
        k = row["path"]
        steps.run("gps", lambda: 1 / (k % 5), queries=1, waits=k % 4)
        if k % 2 == 0:
            steps.run("ocr", lambda: k % 3 != 0)

    at = f"{checkpoint_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"
    steps.recorded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path")), work).write.parquet(at)
    log = spark.read.parquet(at)
    named = steps.extras(log).groupBy("step").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("="), F.col("total").cast("long").cast("string")))), ",").alias("extras"))  # a row a name
    found = steps.summary(log).join(named, "step", "left")
    return found.select("step", "runs", "ok", "errors", ((F.col("total_s") >= 0) & (F.col("avg_s") <= F.col("total_s"))).alias("timed"), F.coalesce("extras", F.lit("")).alias("extras"))


@query("""
SELECT o_orderkey, array_to_string(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL AND x <> ''), '|') AS tags FROM (
  SELECT o_orderkey, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_in_order
  FROM (SELECT o_orderkey, ['t' || (o_orderkey % 3), '', 't' || (o_orderkey % 2), NULL, 't0', 't' || (o_orderkey % 5), ''] AS t FROM orders))
""")
def distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences of a list's tags, without those that are empty."""
    k = F.col("o_orderkey")
    tag = lambda n: F.concat(F.lit("t"), (k % n).cast("string"))
    listed = F.array(tag(3), F.lit(""), tag(2), F.lit(None).cast("string"), F.lit("t0"), tag(5), F.lit(""))
    return table(spark, sf_dir, "orders").select(k, F.array_join(text.distinct_in_order(listed), "|").alias("tags"))


@query("SELECT c_custkey AS path, unnest(['IPTC:Keywords', 'XMP-dc:Subject', 'XMP-digiKam:TagsList', 'XMP-lr:HierarchicalSubject', 'XMP-iptcExt:PersonInImage']) AS field, '=' AS op, '' AS value FROM customer")
def clear_keyword_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.clear_keywords(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a.x=1|a.y=2|b=3' WHEN 1 THEN 'a.x=9|a.y=2|b=3' WHEN 2 THEN 'a=0|b=3|c.d=4' ELSE 'a.x=1|a.y=2|b.e=5' END AS settings FROM customer
""")
def settings_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults with another overlay for each row: none, one leaf, a leaf in place of a group, a group in place of a leaf."""
    k = F.col("c_custkey") % 4
    pairs = lambda *kv: F.create_map(*map(F.lit, kv))
    over = F.when(k == 1, pairs("a.x", "9")).when(k == 2, pairs("a", "0", "c.d", "4")).when(k == 3, pairs("b.e", "5"))
    found = text.overlaid(pairs("a.x", "1", "a.y", "2", "b", "3"), over)
    shown = F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(shown, "|").alias("settings"))


# Text -----------------------------------------------------------------------------------------------------------------

_VOWELS = text.VOWELS
_ONSETS = ", ".join(f"'{x}'" for x in text.ONSETS)
_GOOD = f"""
regexp_full_match(w, '[a-zA-Z0-9À-ÿ][a-zA-Z0-9À-ÿ''.&@#%\\-]{{0,30}}') AND regexp_matches(lower(w), '[{_VOWELS}]')
  AND (length(w) < 2 OR regexp_matches(substr(lower(w), 1, 1), '[{_VOWELS}]') OR regexp_matches(substr(lower(w), 2, 1), '[{_VOWELS}]')
       OR substr(lower(w), 1, 3) IN ({_ONSETS}) OR substr(lower(w), 1, 2) IN ({_ONSETS}))
  AND 2 * length(regexp_replace(w, '[^0-9]', '', 'g')) <= length(w)
"""


@query(f"SELECT w AS word, ({_GOOD}) AS good FROM (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE w <> ''")
def word_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\\s+")).alias("word")).filter("word <> ''").distinct()
    return words.select("word", text.good_word(F.col("word")).alias("good"))


@query(f"""
WITH l AS (
  SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS det_idx, (n_chars % 100) / 100.0::DOUBLE AS score FROM documents),
w AS (SELECT path, det_idx, score, list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '' AND ({_GOOD})) AS words FROM l),
p AS (SELECT path, det_idx, score, words, array_to_string(words, ' ') AS phrase FROM w),
g AS (SELECT * FROM p WHERE score >= 0.60 AND len(words) > 0 AND (len(words) > 1 OR score >= 0.80) AND length(phrase) >= 6),
d AS (SELECT *, row_number() OVER (PARTITION BY path, lower(phrase) ORDER BY det_idx) AS k FROM g),
n AS (SELECT path, phrase, row_number() OVER (PARTITION BY path ORDER BY det_idx)::INT AS n FROM d WHERE k = 1)
SELECT * FROM n WHERE n <= 10
""")
def phrase_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("page_idx"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("score"), F.posexplode(F.split("text", "\n")).alias("det_idx", "text"))
    return ocr.phrases(docs).select("path", "phrase", "n")


@query("SELECT vec_id, round(list_min(xs), 6) AS x, round(list_min(ys), 6) AS y, round(list_max(xs) - list_min(xs), 6) AS w, round(list_max(ys) - list_min(ys), 6) AS h FROM (SELECT vec_id, embedding[1:63:2]::DOUBLE[] AS xs, embedding[2:64:2]::DOUBLE[] AS ys FROM embeddings)")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = lambda k: F.get("embedding", k).cast("double")
    poly = F.transform(F.sequence(F.lit(0), F.lit(62), F.lit(2)), lambda k: F.array(x(k), x(k + 1)))
    b = e.select("vec_id", ocr.box(poly, F.lit(1), F.lit(1)).alias("b"))
    return b.select("vec_id", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in "xywh"])


@query("""
SELECT page_id, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS name, lower(regexp_extract(split_part(regexp_replace(url, '[?#].*$', ''), '/', -1), '[^/.][^/]*?(\\.[^./]+)$', 1)) AS ext FROM pages
""")
def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.url_name(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), text.extension(name).alias("ext"))


# Dates ----------------------------------------------------------------------------------------------------------------

_NAMES = (
    "'IMG-' || d || '-WA' || k || '.jpg'", "'signal-' || ds || '-' || ts || '-789.jpg'", "'photo_' || ds || '_' || ts || '.jpg'", "'PXL_' || d || '_' || t || '123.jpg'",
    "'Screenshot_' || d || '-' || t || '.png'", "d || '_' || t || '.jpg'", "'trip-' || ds || '.jpg'", "'PXL_' || substr(d, 1, 4) || '13' || substr(d, 7, 2) || '_' || t || '.jpg'",
    "'PXL_' || d || '_123460.jpg'", "'IMG_45' || k || '678901.jpg'",
)
_NAME_SQL = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(_NAMES)) + " END"


def _date_case(n: int) -> str:
    label, pattern, timed = temporal.NAME_PATTERNS[n]
    get = lambda k: f"try_cast(regexp_extract(stem, '{pattern}', {k}) AS INT)"
    clock = [get(k) for k in (4, 5, 6)] if timed else ["12", "0", "0"]
    parts = [get(1), get(2), get(3), *clock]
    made = "try_strptime(printf('%04d-%02d-%02d %02d:%02d:%02d', " + ", ".join(parts) + "), '%Y-%m-%d %H:%M:%S')"
    fine = f"{get(1)} >= 1 AND {clock[2]} <= 59"
    return f"CASE WHEN {fine} AND {made} IS NOT NULL THEN {{'ts': {made}, 'label': '{label}'}} END"


_DATES = f"""
SELECT o_orderkey, d.ts AS ts, d.label AS label FROM (
  SELECT o_orderkey, coalesce({", ".join(_date_case(n) for n in range(7))}) AS d FROM (
    SELECT o_orderkey, regexp_replace(name, '\\.[^.]+$', '') AS stem FROM (
      SELECT o_orderkey, {_NAME_SQL} AS name FROM (
        SELECT o_orderkey, o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%Y%m%d') AS d, strftime(o_orderdate, '%Y-%m-%d') AS ds,
               printf('%02d%02d%02d', o_orderkey % 24, o_orderkey % 60, o_orderkey % 53) AS t, printf('%02d-%02d-%02d', o_orderkey % 24, o_orderkey % 60, o_orderkey % 53) AS ts FROM orders))))
"""


def _named_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    clock = [F.lpad((k % n).cast("string"), 2, "0") for n in (24, 60, 53)]
    o = table(spark, sf_dir, "orders").select(k, k.cast("string").alias("k"), F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ds"), F.concat(*clock).alias("t"), F.concat_ws("-", *clock).alias("ts"))
    return o.select("o_orderkey", F.expr(_NAME_SQL).alias("name"))


@query(_DATES)
def filename_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_orders(spark, sf_dir).select("o_orderkey", temporal.name_date(F.col("name")).alias("d")).select("o_orderkey", "d.ts", "d.label")


@query(f"SELECT label, count(*) AS n FROM ({_DATES}) WHERE label IS NOT NULL AND o_orderkey % 3 <> 0 GROUP BY label")
def date_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named_orders(spark, sf_dir).select(F.col("o_orderkey").alias("path"), "name", F.lit(None).cast("timestamp").alias("mtime"), F.when(F.col("o_orderkey") % 3 == 0, "2020:01:01 00:00:00").otherwise("").alias("original"), F.lit(None).cast("string").alias("created"))
    return dates.backfill_counts(dates.backfill(rows, ["filename"]))


@query(f"""
WITH d AS (SELECT o_orderkey AS path, label, CASE WHEN label IS NULL THEN 'unmatched' ELSE 'resolved' END AS kind FROM ({_DATES}) WHERE o_orderkey % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path)::INT AS pos, count(*) OVER (PARTITION BY kind) AS n FROM d)
SELECT kind, pos, path, label, greatest(n - CASE kind WHEN 'resolved' THEN 50 ELSE 20 END, 0)::BIGINT AS more FROM r WHERE pos <= CASE kind WHEN 'resolved' THEN 50 ELSE 20 END
""")
def date_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run of a backfill shows."""
    rows = _named_orders(spark, sf_dir).select(F.col("o_orderkey").alias("path"), "name", F.lit(None).cast("timestamp").alias("mtime"), F.when(F.col("o_orderkey") % 3 == 0, "2020:01:01 00:00:00").otherwise("").alias("original"), F.lit(None).cast("string").alias("created"))
    return dates.preview(rows, ["filename"]).drop("ts")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('minute', ts) END AS ts FROM events")
def exif_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    own = F.when(k % 5 == 0, "not-a-date").when(k % 5 == 1, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).when(k % 5 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k % 5 == 3, F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit(".789+02:00"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", temporal.exif_datetime(own, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("ts"))


# Places ---------------------------------------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'north' ELSE (c_custkey * 37 % 19000 / 100.0 - 95)::VARCHAR END AS lat,
  (c_custkey * 53 % 36200 / 100.0 - 181)::VARCHAR AS lon, CASE c_custkey % 2 WHEN 0 THEN 'S' ELSE 'N' END AS a, CASE c_custkey % 3 WHEN 0 THEN 'W' ELSE 'E' END AS b FROM customer),
n AS (SELECT c_custkey, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon, a, b FROM c),
s AS (SELECT c_custkey, CASE WHEN a = 'S' AND lat > 0 THEN -lat ELSE lat END AS lat, CASE WHEN b = 'W' AND lon > 0 THEN -lon ELSE lon END AS lon FROM n)
SELECT c_custkey, CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN lon END AS lon FROM s
""")
def gps_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.when(k % 6 == 0, None).when(k % 6 == 1, "north").otherwise((k * 37 % 19000 / F.lit(100.0) - 95).cast("string"))
    lon = (k * 53 % 36200 / F.lit(100.0) - 181).cast("string")
    at = geo.coordinates(lat, lon, F.when(k % 2 == 0, "S").otherwise("N"), F.when(k % 3 == 0, "W").otherwise("E"))
    return table(spark, sf_dir, "customer").select(k, at.alias("at")).select("c_custkey", "at.lat", "at.lon")


def _points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 1800 / F.lit(10.0) - 90).alias("lat"), (k * 53 % 3600 / F.lit(10.0) - 180).alias("lon"), *more)


def _spots(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("ord"), F.col("s_name").alias("name"), (k * 97 % 1800 / F.lit(10.0) - 90).alias("place_lat"), (k * 71 % 3600 / F.lit(10.0) - 180).alias("place_lon"), *more)


_C = "SELECT c_nationkey, c_custkey AS id, c_custkey * 37 % 1800 / 10.0::DOUBLE - 90 AS lat, c_custkey * 53 % 3600 / 10.0::DOUBLE - 180 AS lon FROM customer"
_S = "SELECT s_nationkey, s_suppkey AS ord, s_name AS name, s_suppkey * 97 % 1800 / 10.0::DOUBLE - 90 AS place_lat, s_suppkey * 71 % 3600 / 10.0::DOUBLE - 180 AS place_lon FROM supplier"
_KM = """2 * 6371.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))"""
_H = "pow(sin(radians(place_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(place_lat)) * pow(sin(radians(place_lon - lon) / 2), 2) AS h"


@query(f"SELECT id, ord, round({_KM}, 6) AS km FROM (SELECT id, ord, {_H} FROM ({_C}) JOIN ({_S}) ON c_nationkey = s_nationkey)")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of one nation; of those at one place, the distance is worked out once."""
    points = radius.by_place(_points(spark, sf_dir, "c_nationkey"), ["c_nationkey", "lat", "lon"], "ids")
    spots = radius.by_place(_spots(spark, sf_dir, "s_nationkey").drop("name"), ["s_nationkey", "place_lat", "place_lon"], "ords")
    both = points.join(spots, F.col("c_nationkey") == F.col("s_nationkey"))
    km = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")), 6)
    each = both.select("ids", "ords", km.alias("km")).select("ids", F.explode("ords").alias("s"), "km")
    return each.select(F.explode("ids").alias("c"), "s", "km").select("c.id", "s.ord", "km")


@query(f"SELECT id, ord, round(km, 6) AS km FROM (SELECT id, ord, {_KM} AS km FROM (SELECT id, ord, {_H} FROM ({_C}), ({_S}))) WHERE km <= 500")
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers and suppliers at one place each, the distance is worked out once."""
    points = radius.by_place(_points(spark, sf_dir), ["lat", "lon"], "ids")
    spots = radius.by_place(_spots(spark, sf_dir).drop("name"), ["place_lat", "place_lon"], "ords")
    found = radius.radius_join(points, spots, 500.0).select("ids", "ords", F.round("distance_km", 6).alias("km"))
    return found.select("ids", F.explode("ords").alias("s"), "km").select(F.explode("ids").alias("c"), "s", "km").select("c.id", "s.ord", "km")


@query(f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT count(*) AS n FROM v),
d AS (SELECT id, ord, name, {_KM} AS km FROM (SELECT id, ord, name, {_H} FROM ({_C}), ({_S}))),
s AS (SELECT d.*, list_dot_product(a.v, b.v) AS score FROM d, n JOIN v a ON a.vec_id = d.id % n.n JOIN v b ON b.vec_id = d.ord % n.n WHERE km <= 2000),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord)::INT AS rank FROM s)
SELECT id, rank, ord, round(score, 6) AS score, CASE WHEN rank = 1 AND score >= 0.1 THEN name END AS best FROM r WHERE rank <= 5
""")
def radius_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    points = _points(spark, sf_dir).withColumn("vec_id", F.col("id") % n).join(e.withColumnRenamed("embedding", "vec"), "vec_id").drop("vec_id")
    spots = _spots(spark, sf_dir).withColumn("vec_id", F.col("ord") % n).join(e.withColumnRenamed("embedding", "place_vec"), "vec_id").drop("vec_id")
    found = radius.ranked_in_radius(points, spots, 5, 2000.0, 0.1)
    return found.select("id", "rank", "ord", F.round("score", 6).alias("score"), "best")


_BOXES = " ".join(f"WHEN {box} THEN '{name}'" for name, box in geo.REGIONS)


@query(f"SELECT id, CASE {_BOXES} ELSE 'Other' END AS region FROM ({_C})")
def region_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", geo.region().alias("region"))


@query("""
WITH e AS (SELECT event_id, date_trunc('minute', ts) AS ts, event_type IN ('click', 'view') AS has, event_id % 180 - 90.0::DOUBLE AS lat FROM events),
a AS (SELECT ts, arg_min(lat, event_id) AS first_lat, arg_max(lat, event_id) AS last_lat FROM e WHERE has GROUP BY ts),
q AS (SELECT * FROM e WHERE NOT has),
b AS (SELECT q.event_id, a.last_lat AS lat, epoch(q.ts) - epoch(a.ts) AS gap FROM q ASOF JOIN a ON q.ts > a.ts),
f AS (SELECT q.event_id, a.first_lat AS lat, epoch(a.ts) - epoch(q.ts) AS gap FROM q ASOF JOIN a ON q.ts <= a.ts),
j AS (SELECT q.event_id, b.lat AS bl, b.gap AS bg, f.lat AS fl, f.gap AS fg FROM q LEFT JOIN b USING (event_id) LEFT JOIN f USING (event_id)),
p AS (SELECT event_id, CASE WHEN fg IS NULL OR bg <= fg THEN bl ELSE fl END AS lat, CASE WHEN fg IS NULL OR bg <= fg THEN bg ELSE fg END AS gap_s FROM j)
SELECT e.event_id, CASE WHEN e.has THEN e.lat WHEN p.gap_s <= 300 THEN p.lat END AS near_lat, CASE WHEN p.gap_s <= 300 THEN p.gap_s END::DOUBLE AS gap_s FROM e LEFT JOIN p USING (event_id)
""")
def nearest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("event_type").isin("click", "view")
    lat = F.when(has, F.col("event_id") % 180 - F.lit(90.0))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), lat.alias("lat"), lat.alias("lon"))
    return asof.nearest(rows, 300).select(F.col("seq").alias("event_id"), "near_lat", "gap_s")


# Selections -----------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'Europe' WHEN 1 THEN 'Asia' WHEN 2 THEN 'Africa' WHEN 3 THEN 'Atlantis' ELSE 'Oceania' END AS region, p_type AS type, p_size AS sitelinks FROM part),
c AS (SELECT *, greatest(trunc(CASE region WHEN 'Europe' THEN 0.40 WHEN 'Asia' THEN 0.25 WHEN 'Africa' THEN 0.10 WHEN 'Oceania' THEN 0.02 ELSE 0.05 END::DOUBLE * 300)::INT, 1) AS cap FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY region, type ORDER BY sitelinks DESC, ord) AS rk, min(ord) OVER (PARTITION BY region, type) AS tf, min(ord) OVER (PARTITION BY region) AS rf FROM c),
o AS (SELECT *, rk > greatest(cap // 6, 1) AS over FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY over, CASE WHEN over THEN -sitelinks ELSE tf END, tf, rk) AS pos FROM o),
k AS (SELECT *, row_number() OVER (ORDER BY sitelinks DESC, rf, pos)::INT AS place FROM s WHERE pos <= cap)
SELECT ord, region, type, sitelinks, place FROM k WHERE place <= 300
""")
def region_cap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    region = F.when(k % 5 == 0, "Europe").when(k % 5 == 1, "Asia").when(k % 5 == 2, "Africa").when(k % 5 == 3, "Atlantis").otherwise("Oceania")
    rows = table(spark, sf_dir, "part").select(k.alias("ord"), region.alias("region"), F.col("p_type").alias("type"), F.col("p_size").alias("sitelinks"))
    return select.by_region_cap(rows, 300, n_types=6)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS rk, min(p_partkey) OVER (PARTITION BY p_type) AS tf FROM part),
s AS (SELECT *, row_number() OVER (ORDER BY rk > 12, CASE WHEN rk > 12 THEN -p_size ELSE tf END, tf, rk)::INT AS place FROM r)
SELECT p_partkey AS ord, p_type AS type, p_size AS sitelinks, place FROM s WHERE place <= 100
""")
def type_quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("type"), F.col("p_size").alias("sitelinks"))
    return select.by_type_quota(rows, 100, 8)


@query("""
WITH c AS (SELECT l_orderkey AS wikidata_id, CASE l_quantity::INT % 6 WHEN 0 THEN 'P18' WHEN 1 THEN 'P8517' WHEN 2 THEN 'P3451' WHEN 3 THEN 'P7417' WHEN 4 THEN 'P5252' ELSE 'P1' END AS prop, l_linenumber * 1000000 + l_partkey AS claim_ord,
  CASE WHEN l_partkey % 2 = 0 THEN 'A ' ELSE 'a_' END || (l_partkey % 3)::VARCHAR || CASE WHEN l_suppkey % 5 = 0 THEN '.svg' ELSE '.jpg' END AS filename FROM lineitem),
p AS (SELECT *, list_position(['P18', 'P3451', 'P8517', 'P5252', 'P7417'], prop) AS po FROM c WHERE prop <> 'P1' AND NOT filename LIKE '%.svg'),
d AS (SELECT *, row_number() OVER (PARTITION BY wikidata_id, lower(replace(filename, ' ', '_')) ORDER BY po, claim_ord) AS n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY wikidata_id ORDER BY po, claim_ord)::INT AS place FROM d WHERE n = 1)
SELECT wikidata_id, filename, 'wikidata:' || prop AS source, place FROM r WHERE place <= 2
""")
def image_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int") % 6
    prop = F.when(q == 0, "P18").when(q == 1, "P8517").when(q == 2, "P3451").when(q == 3, "P7417").when(q == 4, "P5252").otherwise("P1")
    name = F.concat(F.when(F.col("l_partkey") % 2 == 0, "A ").otherwise("a_"), (F.col("l_partkey") % 3).cast("string"), F.when(F.col("l_suppkey") % 5 == 0, ".svg").otherwise(".jpg"))
    return select.images(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("wikidata_id"), prop.alias("prop"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("claim_ord"), name.alias("filename")), 2)


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def first_query_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("query_ord"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return select.first_query_wins(rows, "l_partkey").select("l_partkey", "ord.*")


# Vectors and clusters -------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, a.vec_id, list_dot_product(a.v, q.v) AS score FROM v a, v q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10
""")
def vector_topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 20, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    best = radius.ranked_everywhere(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("place_vec")), 10)
    return best.select(F.col("query").alias("query_id"), F.col("ord").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("""
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, pos::INT AS pos, round(x / n, 6) AS x FROM m JOIN n USING (label)
""")
def vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = select.vector_mean(table(spark, sf_dir, "embeddings").select(F.col("label").alias("id"), F.col("embedding").alias("vec")))
    return means.select(F.col("id").alias("label"), F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 6))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 7919 % 1000).alias("size"), F.col("embedding").alias("vec"))


_PAIRS = """
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.id < b.id AND list_dot_product(a.v, b.v) >= 0.42)
"""


@query(f"WITH {_PAIRS} SELECT a, b, round(sim, 6) AS sim FROM p")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.similar_pairs(_sized(spark, sf_dir), 0.42).withColumn("sim", F.round("sim", 6))


@query(f"""
WITH RECURSIVE {_PAIRS},
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
l AS (SELECT id, min(c) AS cluster FROM r GROUP BY id),
m AS (SELECT cluster, max(sim) AS max_sim FROM p JOIN l ON p.a = l.id GROUP BY cluster),
k AS (SELECT *, row_number() OVER (ORDER BY max_sim DESC, cluster)::INT AS cluster_rank FROM m)
SELECT l.cluster, l.id, row_number() OVER (PARTITION BY l.cluster ORDER BY l.id * 7919 % 1000 DESC, l.id)::INT AS pos, count(*) OVER (PARTITION BY l.cluster) AS n, round(max_sim, 6) AS max_sim, cluster_rank FROM l JOIN k USING (cluster)
""")
def similar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.clusters(_sized(spark, sf_dir), 0.42).withColumn("max_sim", F.round("max_sim", 6))


def _split_sql(first: float, most: int, step: float = 0.02, top: float = 0.99) -> str:
    """All rounds of the split, one after another: a round's clusters, what is small enough, and what goes on."""
    ctes, out, t, k = ["s0 AS (SELECT vec_id AS id FROM embeddings)"], [], first, 0
    while True:
        following = round(t + step, 4)
        ctes += [
            f"e{k} AS (SELECT a, b FROM p WHERE sim >= {t} AND a IN (FROM s{k}) AND b IN (FROM s{k}) UNION ALL SELECT b, a FROM p WHERE sim >= {t} AND a IN (FROM s{k}) AND b IN (FROM s{k}))",
            f"r{k} AS (SELECT a AS id, a AS c FROM e{k} UNION SELECT e.b, r.c FROM r{k} r JOIN e{k} e ON e.a = r.id)",
            f"m{k} AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY id * 7919 % 1000 DESC, id) AS pos FROM (SELECT id, min(c) AS cluster FROM r{k} GROUP BY id))",
        ]
        out.append(f"SELECT id, {t}::DOUBLE AS threshold, cluster FROM m{k} WHERE n <= {most}")
        if following >= top:
            out.append(f"SELECT id, {t}::DOUBLE, cluster FROM m{k} WHERE n > {most} AND pos <= {most}")
            pairs = f"SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS sim FROM v a JOIN v b ON a.id < b.id AND list_dot_product(a.v, b.v) >= {first}"
            return f"WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS MATERIALIZED ({pairs}), {', '.join(ctes)} {' UNION ALL '.join(out)}"
        ctes.append(f"s{k + 1} AS (SELECT DISTINCT x.id FROM m{k} x JOIN m{k} y ON x.cluster = y.cluster AND x.id <> y.id JOIN p ON p.a = least(x.id, y.id) AND p.b = greatest(x.id, y.id) AND sim >= {following} WHERE x.n > {most})")
        out.append(f"SELECT id, {t}::DOUBLE, cluster FROM m{k} WHERE n > {most} AND pos <= {most} AND cluster NOT IN (SELECT cluster FROM m{k} WHERE id IN (FROM s{k + 1}))")
        t, k = following, k + 1


@query(_split_sql(0.38, 4))
def similar_clusters_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.refined(_sized(spark, sf_dir), 0.38, most=4).withColumn("threshold", F.round("threshold", 2))


# Merging and moving ---------------------------------------------------------------------------------------------------


@query("""
WITH w AS (
  SELECT conv_id, CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS rank, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations),
f AS (SELECT conv_id, w, min((rank, turn, k)) AS pos FROM w GROUP BY ALL)
SELECT conv_id, array_to_string(list(w ORDER BY pos), ' ') AS words FROM f GROUP BY conv_id
""")
def ordered_list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.struct(F.when(F.col("role") == "assistant", 1).otherwise(0).alias("r"), "turn").alias("rank")
    rows = table(spark, sf_dir, "conversations").select("conv_id", rank, F.split("text", " ").alias("words"))
    return merge.merged(rows, ["conv_id"], ["words"], []).withColumn("words", F.array_join("words", " "))


@query("SELECT conv_id, arg_max(role, turn) FILTER (WHERE turn % 3 <> 2) AS role, arg_max(turn, turn) AS n FROM conversations GROUP BY conv_id")
def scalar_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("role"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), role.alias("role"), F.col("turn").alias("n"))
    return merge.merged(rows, ["conv_id"], [], ["role", "n"])


@query("""
WITH RECURSIVE o AS (
  SELECT *, row_number() OVER (PARTITION BY fam ORDER BY ord, path) AS k FROM (
    SELECT o_orderkey AS ord, 'd' || (o_custkey % 10) || '/' || stem || '.jpg' AS path, stem, fam FROM (
      SELECT *, 'f' || (o_orderkey % 400) AS fam, 'f' || (o_orderkey % 400) || CASE o_orderkey % 7 WHEN 0 THEN '_2' WHEN 1 THEN '_3_2' WHEN 2 THEN '_02' ELSE '' END AS stem FROM orders))),
t AS (SELECT fam, list(name) AS taken FROM (
  SELECT 'f' || (n_nationkey * 2) AS fam, 'f' || (n_nationkey * 2) || '.jpg' AS name FROM nation UNION ALL SELECT 'f' || n_nationkey, 'f' || n_nationkey || '_3.jpg' FROM nation) GROUP BY fam),
r AS (
  SELECT f.fam, 0::BIGINT AS k, NULL::VARCHAR AS path, NULL::VARCHAR AS made, coalesce(t.taken, []::VARCHAR[]) AS taken FROM (SELECT DISTINCT fam FROM o) f LEFT JOIN t USING (fam)
  UNION ALL
  SELECT fam, k, path, made, list_append(taken, made) FROM (
    SELECT r.fam, o.k, o.path, r.taken, CASE WHEN NOT list_contains(r.taken, o.stem || '.jpg') THEN o.stem || '.jpg'
      ELSE o.stem || '_' || list_min(list_filter(range(2, len(r.taken) + 3), lambda n: NOT list_contains(r.taken, o.stem || '_' || n || '.jpg'))) || '.jpg' END AS made
    FROM r JOIN o ON o.fam = r.fam AND o.k = r.k + 1))
SELECT path, '/dest/' || made AS moved_to FROM r WHERE k > 0
""")
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that look like suffixed ones of others among them."""
    k = F.col("o_orderkey")
    end = F.when(k % 7 == 0, "_2").when(k % 7 == 1, "_3_2").when(k % 7 == 2, "_02").otherwise("")
    o = table(spark, sf_dir, "orders").select(k.alias("ord"), F.format_string("d%d/f%d%s.jpg", F.col("o_custkey") % 10, k % 400, end).alias("path"))
    n = F.col("n_nationkey")
    taken = table(spark, sf_dir, "nation").select(F.explode(F.array(F.format_string("f%d.jpg", n * 2), F.format_string("f%d_3.jpg", n))).alias("name"))
    return moves.planned_names(o, "/dest", taken)


@query("""
WITH m AS (SELECT o_custkey AS original, arg_max(o_orderkey, o_orderkey) AS moved_to FROM orders GROUP BY 1)
SELECT c_custkey AS path, m.moved_to, CASE WHEN c_custkey % 3 = 0 THEN 'present' WHEN m.moved_to % 2 = 0 THEN 'moved' ELSE 'missing' END AS status FROM customer LEFT JOIN m ON m.original = c_custkey
""")
def move_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    last = moves.latest_moves(o.select(F.col("o_custkey").alias("original"), F.col("o_orderkey").alias("moved_to"), F.col("o_orderkey").alias("line_no")))
    # Two kinds of path: customers are at their own number below zero, moved files at the order's.
    files_ = c.select((-1 - F.col("c_custkey")).alias("path"))
    have = c.filter("c_custkey % 3 = 0").select((-1 - F.col("c_custkey")).alias("path")).union(o.filter("o_orderkey % 2 = 0").select("o_orderkey"))
    found = moves.statuses(files_, have, last.withColumn("original", -1 - F.col("original")))
    return found.withColumn("path", -1 - F.col("path"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'video' WHEN 3 THEN 'video' WHEN 4 THEN 'image' END AS kind FROM orders")
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 6
    heads = ("FFD8FFE000104A4649460001", "89504E470D0A1A0A00000000", "000000206674797069736F6D", "52494646FFFFFFFF41564920", "0000002066747970", "")
    header = F.unhex(F.when(k == 4, F.lit(heads[4] + "68656963")).otherwise(F.element_at(F.array(*map(F.lit, heads)), (k + 1).cast("int"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), files.real_type(header).alias("kind"))


# Changes, paths and files ---------------------------------------------------------------------------------------------


def _named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths /a/d<n>/<name>: pictures, films, motion companions and others."""
    k = F.col("o_orderkey")
    ends = F.element_at(F.array(*map(F.lit, (".jpg", ".HEIC.MOV", ".mp4", ".txt", "", ".png"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k, F.concat(F.lit("/a/d"), (k % 9).cast("string"), F.lit("/f"), k.cast("string"), ends).alias("path"))


_FILES = "SELECT o_orderkey, '/a/d' || (o_orderkey % 9) || '/f' || o_orderkey || (['.jpg', '.HEIC.MOV', '.mp4', '.txt', '', '.png'])[o_orderkey % 6 + 1] AS path FROM orders"


@query(f"""
SELECT path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, path || '.xmp' AS sidecar, regexp_replace(path, '\\.[^./]+$', '') || '.xmp' AS other,
  lower(path) LIKE '%.heic.mov' AS motion, o_orderkey % 6 IN (0, 1, 2, 5) AS supported FROM ({_FILES})
""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _named_files(spark, sf_dir).select(p, text.extension(p).alias("ext"), text.sidecar(p).alias("sidecar"), text.other_sidecar(p).alias("other"), files.motion_companion(p).alias("motion"), files.supported(p).alias("supported"))


@query(f"""
WITH x AS (SELECT path, path || '.xmp' AS a, regexp_replace(path, '\\.[^./]+$', '') || '.xmp' AS b, o_orderkey % 4 = 0 AS has_a, o_orderkey % 5 = 0 AS has_b FROM ({_FILES}))
SELECT path, 'embedded' AS source, path AS physical FROM x UNION ALL SELECT path, 'sidecar', CASE WHEN has_a THEN a ELSE b END FROM x WHERE has_a OR has_b
""")
def sidecar_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named_files(spark, sf_dir)
    have = rows.filter("o_orderkey % 4 = 0").select(text.sidecar(F.col("path")).alias("path")).union(rows.filter("o_orderkey % 5 = 0").select(text.other_sidecar(F.col("path"))))
    return merge.with_sidecars(rows.select("path"), have)


@query(f"""
WITH f AS (SELECT path, o_orderkey % 6 IN (1, 2) AS film FROM ({_FILES})), m AS (SELECT path, film, unnest(['IPTC:Keywords', 'XMP-dc:Subject']) AS field FROM f)
SELECT path, field, path AS target FROM m WHERE NOT film UNION ALL SELECT path, field, path || '.xmp' FROM m WHERE field <> 'IPTC:Keywords'
""")
def write_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named_files(spark, sf_dir).select("path", F.expr("o_orderkey % 6 IN (1, 2)").alias("is_video"), F.explode(F.array(F.lit("IPTC:Keywords"), F.lit("XMP-dc:Subject"))).alias("field"))
    return sinks.targets(rows, sidecars=True).select("path", "field", "target")


@query("""
WITH t AS (SELECT n_nationkey AS path, 'Places/' || n_name AS tag, n_name AS leaf FROM nation UNION ALL SELECT n_nationkey, 'People/' || n_name, n_name FROM nation)
SELECT path, 'IPTC:Keywords' AS field, '-=' AS op, leaf AS value FROM t
UNION ALL SELECT path, 'XMP-dc:Subject', '-=', leaf FROM t
UNION ALL SELECT path, 'XMP-digiKam:TagsList', '-=', tag FROM t
UNION ALL SELECT path, 'XMP-lr:HierarchicalSubject', '-=', replace(tag, '/', '|') FROM t
UNION ALL SELECT path, 'XMP-iptcExt:PersonInImage', '-=', leaf FROM t WHERE starts_with(tag, 'People/')
""")
def tag_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return sinks.removals(n.select(F.col("n_nationkey").alias("path"), F.explode(F.array(*[F.concat(F.lit(r), F.col("n_name")) for r in ("Places/", "People/")])).alias("tag")))


@query("""
SELECT n_nationkey AS path, unnest(['IPTC:Keywords', 'XMP-dc:Subject', 'XMP-digiKam:TagsList', 'XMP-lr:HierarchicalSubject', 'XMP-iptcExt:PersonInImage',
  'MicrosoftPhoto:LastKeywordXMP', 'MediaPro:CatalogSets', 'MicrosoftPhoto:CategorySet', 'XMP-album:all']) AS field, '=' AS op, '' AS value, 0 AS op_seq FROM nation
UNION ALL
SELECT path, field, '+=', CASE WHEN field = 'XMP-digiKam:TagsList' THEN 'People/' || n_name WHEN field = 'XMP-lr:HierarchicalSubject' THEN 'People|' || n_name ELSE n_name END, 1
FROM (SELECT n_nationkey AS path, n_name, unnest(['IPTC:Keywords', 'XMP-dc:Subject', 'XMP-digiKam:TagsList', 'XMP-lr:HierarchicalSubject', 'XMP-iptcExt:PersonInImage']) AS field FROM nation)
WHERE path % 2 = 0
""")
def clear_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "path")
    return sinks.clear_all(n, n.filter("path % 2 = 0").select("path", F.array(F.concat(F.lit("People/"), F.col("n_name"))).alias("tags")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'y a' ELSE concat_ws(' ', nullif(array_to_string(list_filter(w, lambda x: x <> 'w3' AND x <> 'w5'), ' '), ''), 'new2 new1 w3') END AS tags
FROM (SELECT doc_id, ['w' || (doc_id % 4), 'w' || (doc_id % 6), 'w' || (doc_id % 3), 'w8'] AS w FROM documents)
""")
def mutations_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six changes to each list, and four more to every third: what goes, comes, comes back, and is replaced."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("path"), F.lit("S").alias("field"), F.array(*[F.concat(F.lit("w"), (k % n).cast("string")) for n in (4, 6, 3)], F.lit("w8")).alias("values"))
    steps_ = [("-=", "w3"), ("+=", "new2"), ("+=", "new1"), ("-=", "w5"), ("+=", "w8"), ("+=", "w3"), ("=", "z"), ("=", "y"), ("+=", "a"), ("-=", "z")]
    ops = F.array(*[F.struct(F.lit(n).alias("op_seq"), F.lit(o).alias("op"), F.lit(v).alias("value")) for n, (o, v) in enumerate(steps_)])
    changes = rows.select("path", "field", F.explode(ops).alias("m")).select("path", "field", "m.*").filter("path % 3 = 0 OR op_seq < 6")
    return sinks.applied(rows, changes).select(F.col("path").alias("doc_id"), F.array_join("values", " ").alias("tags"))


@query("""
SELECT path, unnest([part1, part2]) AS field, '=' AS op, value FROM (
  SELECT s_suppkey AS path, 'XMP-photoshop:City' AS part1, 'IPTC:City' AS part2, s_name AS value FROM supplier
  UNION ALL SELECT s_suppkey, 'XMP-photoshop:Country', 'IPTC:Country-PrimaryLocationName', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")
def location_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = F.create_map(F.lit("City"), F.col("s_name"), F.lit("Country"), F.col("n_name"), F.lit("Planet"), F.lit("Earth"))
    return tags.location_fan_out(s.select(F.col("s_suppkey").alias("path"), parts.alias("parts")))


@query("SELECT doc_id, CASE WHEN length(text) > 20 THEN substr(text, 1, 19) || '…' ELSE text END AS short, least(n_chars, ceil(sqrt(n_chars::DOUBLE)))::INT AS cols, ceil(n_chars::DOUBLE / least(n_chars, ceil(sqrt(n_chars::DOUBLE))))::INT AS n_rows FROM documents WHERE n_chars > 0")
def displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("n_chars > 0")
    return docs.select("doc_id", text.shortened(F.col("text"), 20).alias("short"), text.grid(F.col("n_chars")).alias("g")).select("doc_id", "short", "g.cols", F.col("g.rows").alias("n_rows"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS took FROM (SELECT event_id, (event_id * 37 % 9000)::BIGINT AS s FROM events)")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.duration((F.col("event_id") * 37 % 9000).cast("double")).alias("took"))


@query("""
SELECT region, pool, greatest(trunc(CASE region WHEN 'Europe' THEN 0.40 WHEN 'Asia' THEN 0.25 ELSE 0.05 END::DOUBLE * 300)::INT, 1) AS cap, coalesce(picked, 0) AS picked
FROM (SELECT (['Europe', 'Asia', 'Atlantis'])[p_partkey % 3 + 1] AS region, count(*) AS pool FROM part GROUP BY 1)
LEFT JOIN (SELECT (['Europe', 'Asia', 'Atlantis'])[p_partkey % 3 + 1] AS region, count(*) AS picked FROM part WHERE p_size > 40 AND p_partkey % 3 <> 1 GROUP BY 1) USING (region)
""")
def region_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, ("Europe", "Asia", "Atlantis"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("region"), "p_size")
    return select.region_pools(rows, rows.filter("p_size > 40 AND region <> 'Asia'"), 300)


_ROOTED = "SELECT o_custkey AS root, o_orderkey AS k, '/r' || (o_custkey % 10) || '/ab' || (['', 'c', '/c', 'cd'])[o_orderkey % 4 + 1] || '/f' || o_orderkey AS path FROM orders"


@query(f"""
WITH RECURSIVE f AS (SELECT root, k, regexp_replace(path, '/[^/]*$', '') AS d FROM ({_ROOTED})),
a AS (
  SELECT root, arg_min(d, k) AS a FROM f GROUP BY root
  UNION ALL SELECT root, regexp_replace(a, '/[^/]*$', '') FROM a WHERE a <> ''),
g AS (SELECT a.root, a.a FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.root = a.root AND NOT starts_with(f.d, a.a)))
SELECT root, arg_max(a, length(a)) AS ancestor FROM g GROUP BY root
""")
def common_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestor of each customer's files, in the order of their keys; folders are text prefixes of others."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    below = F.element_at(F.array(*map(F.lit, ("", "c", "/c", "cd"))), (k % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(c.alias("root"), k.alias("k"), F.concat(F.lit("/r"), (c % 10).cast("string"), F.lit("/ab"), below, F.lit("/f"), k.cast("string")).alias("path"))
    return moves.common_ancestor(rows, "k", "root")


@query(f"""
WITH f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS d FROM ({_FILES})), m AS (SELECT string_split(min(d), '/') AS parts FROM f),
p AS (SELECT array_to_string(parts[1:k], '/') AS a FROM m, range(1, 9) t(k))
SELECT a AS ancestor FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE NOT (d = a OR starts_with(d, a || '/'))) ORDER BY length(a) DESC LIMIT 1
""")
def common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves.common_ancestor(_named_files(spark, sf_dir))


@query("SELECT vec_id, (unnest(range(len(embedding))))::INT AS pos, unnest(embedding) AS x FROM embeddings")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as text and back, bit for bit."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.decoded(vectors.encoded("embedding")).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("pos", "x"))


#: One point after another.
_LEADERS = """
WITH RECURSIVE p AS (
  SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_custkey AS seq, c_custkey * 37 % 1800 / 10.0::DOUBLE - 90 AS lat, c_custkey * 53 % 3600 / 10.0::DOUBLE - 180 AS lon FROM customer),
r AS (
  SELECT 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS leader, []::STRUCT(seq BIGINT, lat DOUBLE, lon DOUBLE)[] AS leaders
  UNION ALL
  SELECT k, seq, coalesce(hit, seq), CASE WHEN hit IS NULL THEN list_append(leaders, {'seq': seq, 'lat': lat, 'lon': lon}) ELSE leaders END FROM (
    SELECT p.k, p.seq::BIGINT AS seq, p.lat, p.lon, r.leaders, (list_filter(r.leaders, lambda q:
      2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2)))) < 500))[1].seq AS hit
    FROM r JOIN p ON p.k = r.k + 1))
SELECT seq, leader FROM r WHERE k > 0
"""


@query(_LEADERS)
def leader_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radius.leader_cache(_points(spark, sf_dir).withColumnRenamed("id", "seq"), 500.0)


@query("""
WITH r AS (SELECT o_orderkey AS path, CASE o_orderkey % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'rewrite' END AS action, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END::INT AS n_keep FROM orders)
SELECT path, action, n_keep FROM r WHERE action IS NOT NULL
""")
def region_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    region = lambda kind, about: F.struct(F.lit(kind).alias("Type"), F.lit(about).alias("Description"))
    ours, other = region("BarCode", "text"), region("BarCode", "code")
    regions = F.when(k == 0, F.array(ours, ours)).when(k == 1, F.array(ours, other)).when(k == 2, F.array(other))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), regions.alias("regions"))
    return ocr.region_cleanup(rows, "text").select("path", "action", F.size("keep").alias("n_keep"))
