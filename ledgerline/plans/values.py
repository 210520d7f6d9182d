"""Queries on written values, dates and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, formats, ids, stats
from ..operators import cells, evaluate, latest, templates, usage
from ..sources.files import table
from .catalog import query

_WRITTEN = """
w AS (SELECT o_orderkey AS k, ['integer', 'decimal', 'time', 'time_range', 'reading', NULL][1 + o_orderkey % 6] AS f,
             CASE (o_orderkey // 6) % 9 WHEN 0 THEN '00' || o_custkey WHEN 1 THEN ' 0' || o_custkey || '.50 ' WHEN 2 THEN (o_orderkey % 26) || ':' || lpad((o_custkey % 61)::VARCHAR, 2, '0')
                  WHEN 3 THEN lpad((o_custkey % 2500)::VARCHAR, 4, '0') WHEN 4 THEN (o_orderkey % 25) || '-' || (o_custkey % 25) WHEN 5 THEN '０' || (o_custkey % 10) || '．' || lpad((o_orderkey % 60)::VARCHAR, 2, '0')
                  WHEN 6 THEN o_orderstatus || ' x' WHEN 7 THEN (o_custkey % 24) || ' : 30 ～ ' || (o_orderkey % 24) || '.15' ELSE '' END AS t FROM orders)
"""
_CLOCK = """
    CASE WHEN regexp_full_match({t}, '[0-9]{{1,2}}[{sep}][0-9]{{2}}') AND CAST(right({t}, 2) AS INT) < 60 AND CAST(regexp_extract({t}, '^[0-9]+') AS INT) * 60 + CAST(right({t}, 2) AS INT) <= 1440
         THEN lpad(regexp_extract({t}, '^[0-9]+'), 2, '0') || ':' || right({t}, 2)
         WHEN regexp_full_match({t}, '[0-9]{{3,4}}') AND CAST(right({t}, 2) AS INT) < 60 AND CAST(left({t}, length({t}) - 2) AS INT) * 60 + CAST(right({t}, 2) AS INT) <= 1440
         THEN lpad(left({t}, length({t}) - 2), 2, '0') || ':' || right({t}, 2)
         WHEN regexp_full_match({t}, '[0-9]{{1,2}}') AND CAST({t} AS INT) <= 24 THEN lpad({t}, 2, '0') || ':00' END"""
_DECIMAL = "CASE WHEN regexp_full_match({t}, '[0-9]+([.][0-9]+)?') THEN regexp_replace({t}, '^0+([0-9])', '\\1') END"


def _written() -> tuple:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    fmt = F.get(F.array(*[F.lit(x) for x in (*formats.FORMATS, None)]), (k % 6).cast("int"))
    case = F.floor(k / 6) % 9
    two = lambda x, n=2: F.lpad(s(x), n, "0")
    text = (
        F.when(case == 0, F.concat(F.lit("00"), s(c))).when(case == 1, F.concat(F.lit(" 0"), s(c), F.lit(".50 "))).when(case == 2, F.concat(s(k % 26), F.lit(":"), two(c % 61)))
        .when(case == 3, two(c % 2500, 4)).when(case == 4, F.concat(s(k % 25), F.lit("-"), s(c % 25))).when(case == 5, F.concat(F.lit("０"), s(c % 10), F.lit("．"), two(k % 60)))
        .when(case == 6, F.concat(F.col("o_orderstatus"), F.lit(" x"))).when(case == 7, F.concat(s(c % 24), F.lit(" : 30 ～ "), s(k % 24), F.lit(".15"))).otherwise("")
    )
    return fmt, text


@query(f"""
WITH {_WRITTEN}, p AS (SELECT k, f, t, replace(translate(trim(t), '０．～', '0.~'), ' ', '') AS x FROM w), q AS (SELECT *, string_split(replace(x, '-', '~'), '~') AS r FROM p)
SELECT k AS o_orderkey, f AS format, t AS written, CASE WHEN f IS NULL THEN trim(t) WHEN f = 'integer' THEN CASE WHEN regexp_full_match(x, '[0-9]+') THEN regexp_replace(x, '^0+([0-9])', '\\1') END
       WHEN f = 'decimal' THEN {_DECIMAL.format(t="x")} WHEN f = 'time' THEN {_CLOCK.format(t="x", sep=":.")}
       WHEN f = 'time_range' THEN CASE WHEN len(r) = 2 THEN ({_CLOCK.format(t="r[1]", sep=":.")}) || '~' || ({_CLOCK.format(t="r[2]", sep=":.")}) END
       ELSE CASE WHEN contains(x, ':') THEN {_CLOCK.format(t="x", sep=":")} ELSE {_DECIMAL.format(t="x")} END END AS canonical FROM q""")
def format_normalize(spark: SparkSession, d: str) -> DataFrame:
    fmt, text = _written()
    return formats.with_canonical(table(spark, d, "orders").select("o_orderkey", fmt.alias("format"), text.alias("written")), "format", "written", "canonical")


@query("""
WITH t AS (SELECT o_orderkey, (o_custkey % 30) || '.' || lpad((o_orderkey % 70)::VARCHAR, 2, '0') AS t, o_custkey % 30 AS h, o_orderkey % 70 AS m FROM orders)
SELECT o_orderkey, t, CASE WHEN m <= 59 AND h * 60 + m <= 1440 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') END AS clock FROM t""")
def dotted_clock(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat((F.col("o_custkey") % 30).cast("string"), F.lit("."), F.lpad((F.col("o_orderkey") % 70).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", t.alias("t"), formats.dotted_clock(t).alias("clock"))


@query("""
WITH t AS (SELECT o_orderkey, o_custkey % 1440 AS a, (o_orderkey * 7) % 1440 AS b FROM orders)
SELECT o_orderkey, (CASE WHEN b >= a THEN b - a ELSE b + 1440 - a END)::INTEGER AS minutes FROM t""")
def time_span(spark: SparkSession, d: str) -> DataFrame:
    clock = lambda x: F.concat(F.lpad(F.floor(x / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((x % 60).cast("string"), 2, "0"))
    text = F.concat(clock(F.col("o_custkey") % 1440), F.lit("~"), clock((F.col("o_orderkey") * 7) % 1440))
    return table(spark, d, "orders").select("o_orderkey", formats.range_minutes(text).alias("minutes"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate AS x, o_orderdate + INTERVAL 40 DAY AS r FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE strftime(x, '%Y-%m-%d') END AS parsed FROM t""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in all notations, read as of forty days later; the last notation isn't a date."""
    x, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    # two-digit years are of this century, so dates of the last one are written out
    old, f = F.year(x) < 2000, F.date_format
    text = (
        F.when(k == 7, f(x, "yyyy-13-dd")).when((k == 0) | (old & k.isin(3, 4)), f(x, "yyyy-MM-dd")).when(k == 1, f(x, "yyyy.M.d")).when(k == 2, f(x, "yyyyMMdd"))
        .when(k == 3, f(x, "yy/MM/dd")).when(k == 4, f(x, "yyMMdd")).when(k == 5, f(x, "MMdd")).otherwise(f(x, "M-d"))
    )
    return table(spark, d, "orders").select("o_orderkey", dates.parse_date(text, F.date_add(F.to_date(x), 40)).alias("parsed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "day", CASE WHEN o_custkey % 90 > 50 THEN 'future' WHEN 50 - o_custkey % 90 > 31 THEN 'far' END AS warning FROM orders""")
def iso_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.substring(day, 1, 8), F.lit("32"))).otherwise(day)
    later = F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 90).cast("int")), "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", dates.iso_date(text).alias("day"), dates.date_warning(later, F.date_add(F.to_date("o_orderdate"), 50)).alias("warning"))


@query("""
WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer)
SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + ('0x' || h[17])::INT % 4, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", ids.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("id"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS \"day\", CASE WHEN ('0x' || substr(sha256('salt:' || strftime(o_orderdate, '%Y-%m-%d')), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM orders GROUP BY 1, 2")
def split_by_hash(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("split", ids.split_of(F.col("day"), "salt"))


@query("""
WITH t AS (SELECT p_partkey, p_name AS a, substr(p_name, 1, 3 + p_partkey % 12) AS b FROM part)
SELECT p_partkey, levenshtein(trim(b), a) / length(a)::DOUBLE AS cer FROM t""")
def cer_pairs(spark: SparkSession, d: str) -> DataFrame:
    pred = F.expr("substr(p_name, 1, 3 + p_partkey % 12)")
    return table(spark, d, "part").select("p_partkey", stats.cer(pred, F.col("p_name")).alias("cer"))


@query("""
WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS k FROM documents GROUP BY 1), p AS (SELECT *, k / n::DOUBLE AS p, 3.8416 AS z FROM g)
SELECT lang, n, k, round(greatest(0, (p + z / (2 * n)) / (1 + z / n) - 1.96 * sqrt(p * (1 - p) / n + z / (4.0 * n * n)) / (1 + z / n)), 6) AS low,
       round(least(1, (p + z / (2 * n)) / (1 + z / n) + 1.96 * sqrt(p * (1 - p) / n + z / (4.0 * n * n)) / (1 + z / n)), 6) AS high FROM p""")
def wilson_rate(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_discount >= 0.05 THEN 0 ELSE 1 END ELSE 1 END AS has_value,
       CASE WHEN l_discount >= 0.05 AND (l_returnflag = 'N' OR (l_returnflag = 'A' AND l_quantity <= 40)) THEN 'auto' ELSE 'pending' END AS status FROM lineitem""")
def number_status(spark: SparkSession, d: str) -> DataFrame:
    answer = F.when(F.col("l_returnflag") == "N", "empty").when(F.col("l_returnflag") == "A", "value").otherwise("reject")
    s = cells.number_status(answer, F.col("l_quantity").cast("long").cast("string"), F.col("l_discount"), F.lit(0.05), F.lit(40))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", s.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.*")


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'empty' ELSE 'unknown' END WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'empty' ELSE 'value' END
       ELSE CASE WHEN event_id % 2 = 0 THEN 'empty' ELSE 'value' END END AS kind FROM events""")
def cell_states(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    final = F.when(i % 5 == 0, F.lit("")).otherwise("12")
    form = F.when(i % 5 == 1, "decimal").otherwise("integer")
    s = cells.state(form, (i % 2).cast("int"), final, F.when(i % 3 == 0, "pending").otherwise("auto"))
    return table(spark, d, "events").select("event_id", s["kind"].alias("kind"))


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'printed' WHEN event_id % 13 = 0 THEN 'meta' WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'illegible' ELSE 'pending' END WHEN event_id % 5 = 0 THEN 'empty'
       WHEN event_id % 7 = 0 THEN 'mark' WHEN event_type = 'view' THEN 'present' ELSE 'value' END AS state FROM events""")
def sheet_states(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "printed").when(i % 7 == 0, "checkmark").otherwise("handwritten_number")
    s = cells.sheet_state(kind, F.when(i % 3 == 0, "pending").otherwise("auto"), F.when(i % 2 == 0, "someone"), (i % 5 != 0).cast("int"), F.when(F.col("event_type") != "view", F.col("event_type")), F.when(i % 13 == 0, "m"), F.lit(None).cast("string"))
    return table(spark, d, "events").select("event_id", s.alias("state"))


@query("""
WITH r AS (SELECT o_orderkey AS k, CASE WHEN max(CASE WHEN l_tax = 0 AND l_discount > 0.08 THEN 1 ELSE 0 END) = 1 THEN 'illegible' WHEN max((l_tax = 0)::INT) = 1 THEN 'pending' WHEN min((l_discount = 0)::INT) = 1 THEN 'empty' ELSE 'value' END AS state,
                  CASE WHEN max((l_tax = 0)::INT) = 1 THEN 'pending' WHEN max((l_linestatus = 'O')::INT) = 1 THEN 'reviewed' ELSE 'auto' END AS review_status
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT k AS l_orderkey, state, review_status FROM r""")
def row_rollups(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_tax") == 0, "pending").when(F.col("l_linestatus") == "O", "reviewed").otherwise("auto")
    state = cells.row_state(status, F.when(F.col("l_discount") > 0.08, "someone"), (F.col("l_discount") != 0).cast("int"))
    lines = table(spark, d, "lineitem").withColumn("state", state).withColumn("status", status)
    lines = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return lines.groupBy("l_orderkey").agg(cells.worst(F.col("state")).alias("state"), cells.rollup_status(F.col("status")).alias("review_status"))


@query("""
WITH c AS (SELECT l_orderkey AS page_id, l_linenumber, l_suppkey, l_partkey, l_returnflag || l_linestatus AS name, l_tax AS err, l_quantity::INT AS inliers, l_quantity >= 20 AS ok, l_suppkey || '-' || l_partkey || '-' || l_linenumber AS n FROM lineitem),
o AS (SELECT *, bool_or(ok) OVER (PARTITION BY page_id) AS any_ok FROM c), p AS (SELECT * FROM o WHERE ok OR NOT any_ok), q AS (SELECT *, min(err) OVER (PARTITION BY page_id) AS low FROM p)
SELECT page_id, n AS name, err AS grid_err, inliers FROM q WHERE err <= low + 0.02 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY inliers DESC, n) = 1""")
def choose_variant(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.concat_ws("-", "l_suppkey", "l_partkey", "l_linenumber").alias("name"), (F.col("l_quantity") >= 20).alias("ok"), F.col("l_tax").alias("grid_err"), F.col("l_quantity").cast("int").alias("inliers"))
    return usage.choose_variant(c, 0.02)


@query("""
WITH s AS (SELECT l_orderkey AS page_id, l_returnflag AS family, max(l_quantity)::INT AS inliers FROM lineitem GROUP BY 1, 2), r AS (SELECT *, lead(inliers) OVER w AS second, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY page_id ORDER BY inliers DESC, family))
SELECT page_id, CASE WHEN inliers >= 30 THEN family END AS family, inliers, inliers / second::DOUBLE AS margin FROM r WHERE n = 1""")
def classify_margin(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("family")).agg(F.max("l_quantity").cast("int").alias("inliers"))
    return usage.classify(s, 30)


@query("""
WITH b AS (SELECT l_orderkey AS cell_id, l_returnflag AS kind, (l_quantity::INT % 3)::VARCHAR AS value, l_linenumber::VARCHAR AS text, l_suppkey AS p FROM lineitem),
g AS (SELECT cell_id, kind, value, sum(p)::BIGINT AS probability, arg_max(text, (p, text)) AS text FROM b GROUP BY ALL)
SELECT cell_id, arg_max(kind || '|' || value, (probability, value, kind)) AS answer, max(probability) AS probability FROM g GROUP BY 1""")
def merged_answers(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("kind"), (F.col("l_quantity").cast("int") % 3).cast("string").alias("value"), F.col("l_linenumber").cast("string").alias("text"), F.col("l_suppkey").alias("probability"))
    return evaluate.merge_answers(b).select("cell_id", F.concat_ws("|", "kind", "value").alias("answer"), "probability")


@query("SELECT page_id, string_split(url, '/')[3] AS host, length(html) AS chars, regexp_matches(lower(html), '<article') AS has_article, CASE WHEN url LIKE 'https:%' THEN 1 ELSE 0 END AS secure FROM pages")
def html_pages_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("host"), F.char_length("html").cast("long").alias("chars"), F.lower("html").contains("<article").alias("has_article"), F.col("url").startswith("https:").cast("int").alias("secure"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INTEGER AS place, length(text) AS chars FROM conversations")
def conversation_order(spark: SparkSession, d: str) -> DataFrame:
    place = latest.rank_in(["conv_id"], [F.col("turn"), F.col("role")])
    return table(spark, d, "conversations").select("conv_id", "turn", place.alias("place"), F.char_length("text").cast("long").alias("chars"))


@query("""
WITH k AS (SELECT page_id, [x FOR x IN string_split(replace(url, 'http', 'intake/http'), '/') IF x <> ''] AS parts, page_id % 2 = 0 AS rel, [x FOR x IN string_split(url, '/') IF x <> ''] AS own FROM pages)
SELECT page_id, row_number() OVER (ORDER BY CASE WHEN rel THEN 1 ELSE 0 END, CASE WHEN rel THEN parts ELSE own END, lpad(page_id::VARCHAR, 9, '0'))::INTEGER AS place FROM k""")
def document_order(spark: SparkSession, d: str) -> DataFrame:
    """Places in the order of documents: those received (even ids here) after the others, then by parts of the path."""
    rel = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("intake/"), F.col("url")))
    key = latest.document_key(rel, F.col("url"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    return latest.places(table(spark, d, "pages").select("page_id", key.alias("k")), [F.col("k")]).select("page_id", F.col("place").cast("int").alias("place"))


@query("""
WITH c(n, name, kind) AS (VALUES (0, 'start', 'handwritten_number'), (1, 'end', 'handwritten_number'), (2, 'note', 'handwritten_text'))
SELECT 't' || n_regionkey AS template, 'r' AS region, n_nationkey AS row_no, n_name AS row_key, name AS field_name, kind, n * 100 AS x0, (n + 1) * 100 AS x1, n_nationkey * 20 + 20 AS y0, n_nationkey * 20 + 40 AS y1 FROM nation, c""")
def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("template"), F.lit("r").alias("region"), F.col("n_nationkey").alias("row"), F.col("n_name").alias("key"))
    region = table(spark, d, "region").select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("template"), F.lit("r").alias("region"))
    regions = region.withColumn("header_rows", F.lit(1)).withColumn("ys", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: i * 20)).withColumn("xs", F.array(*[F.lit(x) for x in (0, 100, 200, 300)]))
    named = F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(None).cast("string").alias("format")) for i, (n, k) in enumerate([("start", "handwritten_number"), ("end", "handwritten_number"), ("note", "handwritten_text")])]))
    return templates.region_cells(regions, region.select("template", "region", named), rows).drop("format")


@query("""
WITH f AS (SELECT event_id // 3 AS p, event_id % 3 AS k, (event_id // 3) % 4 = 0 AND event_id % 3 < 2 AS clock, floor(value)::INT AS v, event_id % 7 = 0 AS unknown, event_id % 7 <> 0 AND event_id % 5 = 0 AS blank FROM events),
g AS (SELECT p, max(CASE WHEN k = 0 AND NOT unknown AND NOT blank AND NOT clock THEN v + 0.5 END) AS ms, max(CASE WHEN k = 1 AND NOT unknown AND NOT blank AND NOT clock THEN v + 0.5 END) AS me, max(CASE WHEN k = 2 AND NOT unknown AND NOT blank THEN v + 0.5 END) AS mt,
             max(CASE WHEN k = 0 AND NOT unknown AND NOT blank AND clock THEN v % 24 END) AS cs, max(CASE WHEN k = 1 AND NOT unknown AND NOT blank AND clock THEN v % 24 END) AS ce,
             bool_or(unknown AND k = 0) AS us, bool_or(unknown AND k = 1) AS ue, bool_or(unknown AND k = 2) AS ut FROM f GROUP BY p),
b AS (SELECT *, CASE WHEN us OR ue OR ut THEN 'pending' WHEN ms IS NOT NULL OR me IS NOT NULL THEN 'meter' WHEN cs IS NOT NULL OR ce IS NOT NULL THEN 'clock' WHEN mt IS NOT NULL THEN 'meter' ELSE 'empty' END AS kind,
             CASE WHEN us OR ue THEN NULL WHEN ms IS NOT NULL AND me IS NOT NULL THEN 'meter' WHEN ut THEN NULL WHEN mt IS NOT NULL THEN 'total' WHEN cs IS NOT NULL AND ce IS NOT NULL THEN 'clock' END AS basis FROM g)
SELECT p::VARCHAR AS page_id, kind AS reading_kind, basis AS hours_basis, CASE basis WHEN 'meter' THEN me - ms WHEN 'total' THEN mt WHEN 'clock' THEN CASE WHEN ce >= cs THEN ce - cs ELSE ce + 24 - cs END END::DOUBLE AS hours FROM b""")
def usage_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hours of a machine's day from start, end and total cells: every third event is one of a page's three."""
    i, v = F.col("event_id"), F.floor("value").cast("int")
    page = F.floor(i / 3)
    slot = F.get(F.array(F.lit("start"), F.lit("end"), F.lit("total")), (i % 3).cast("int"))
    clock = (page % 4 == 0) & (i % 3 < 2)
    text = F.when(clock, F.concat(F.lpad((v % 24).cast("string"), 2, "0"), F.lit(":00"))).otherwise(F.concat(v.cast("string"), F.lit(".5")))
    status, has = F.when(i % 7 == 0, "pending").otherwise("auto"), (i % 5 != 0).cast("int")
    f = table(spark, d, "events").select(
        page.cast("string").alias("page_id"), F.lit("meter").alias("role"), F.lit("m").alias("region"), F.lit(0).alias("row_no"), F.lit(0).alias("x0"), F.lit("day").alias("row_key"), slot.alias("field_name"), F.lit("handwritten_number").alias("kind"), F.lit("reading").alias("format"),
        has.alias("has_value_raw"), has.alias("has_value"), text.alias("value_final"), text.alias("value_raw"), status.alias("review_status"), status.alias("status_raw"), i.cast("string").alias("field_id"), F.lit(False).alias("row_subtotal"),
    )
    return usage.usage_rows(f).select("page_id", "reading_kind", "hours_basis", "hours")
