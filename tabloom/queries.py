"""Registered queries of the library and their DuckDB SQL, outside the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import grid as G
from .operators import layout as L
from .operators import ontology as O
from .operators import sheets as X
from .operators import tables as P
from .operators.fuzzy import best_term
from .operators.metadata import Field, quick_scan, with_fallbacks
from .plans import draft as D
from .plans.contract import Contract, interpret
from .session import table
from .streaming import events as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# --- text and values ------------------------------------------------------------------------

_WS = r"[\t\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(translate(text, chr(160) || '‘’“”–—' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288), ' ''''""--'),
       '[ \t]{{2,}}', ' ', 'g'), '(?m){_WS}', '', 'g') AS text FROM documents""")
def normalize_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("text"))


@query("""SELECT p_partkey, trim(lower(p_name)) || ' (' || lower(p_type) || ') x' AS alias FROM part""")
def alias_normalize_parts(spark, sf):
    raw = F.concat(F.lit('  "'), "p_name", F.lit('"( '), F.upper("p_type"), F.lit(" )x"))
    return table(spark, sf, "part").select("p_partkey", T.normalize_alias(raw).alias("alias"))


CATEGORIES = {"license": ["license", "public work"], "contact": ["mail", "token"], "junk": ["idiot", "trash", "scum"]}


def _score(words):
    one = lambda w: r"\s+".join(f"{x}(s|es|ed|ing)?" for x in w.split())
    return " + ".join(f"(CASE WHEN regexp_matches(text, '(^|[^a-zA-Z]){one(w)}([^a-zA-Z]|$)', 'i') THEN 1 ELSE 0 END)" for w in words)


@query(f"""WITH s AS (SELECT doc_id, {', '.join(f'{_score(w)} AS {k}' for k, w in CATEGORIES.items())} FROM documents)
SELECT doc_id, CASE WHEN greatest(license, contact, junk) = 0 THEN 'other' WHEN license = greatest(license, contact, junk) THEN 'license'
       WHEN contact = greatest(license, contact, junk) THEN 'contact' ELSE 'junk' END AS category FROM s""")
def keyword_classify_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.classify(d, "text", CATEGORIES).alias("category"))


_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[[:punct:]]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')))"


@query(f"""WITH t AS (SELECT p_partkey, {_TOK.format('p_name')} AS a, {_TOK.format('p_type')} AS b FROM part)
SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))::DOUBLE END AS similarity FROM t""")
def header_tokens_jaccard(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.jaccard(T.header_tokens("p_name"), T.header_tokens("p_type")).alias("similarity"))


@query("""WITH c AS (SELECT unnest([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d/%m/%Y'), '(' || (o_orderkey * 7)::VARCHAR || '.50)', o_orderpriority, o_orderstatus, '', '-,.']) AS x FROM orders)
SELECT CASE WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR regexp_matches(x, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$') OR regexp_matches(x, '^[0-9]{4}$') THEN 'date'
            WHEN regexp_matches(x, '^\\([0-9.]+\\)$') THEN 'number' ELSE 'string' END AS kind, count(*) AS n FROM c GROUP BY 1""")
def cell_types(spark, sf):
    o = table(spark, sf, "orders")
    cells = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.lit("("), (F.col("o_orderkey") * 7).cast("string"), F.lit(".50)")), "o_orderpriority", "o_orderstatus", F.lit(""), F.lit("-,."))
    return o.select(F.explode(cells).alias("x")).groupBy(T.cell_type("x").alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderkey, 'As of ' || strftime(o_orderdate, '%Y-%m-%d') || ', FY ' || strftime(o_orderdate, '%y') AS x FROM orders)
SELECT o_orderkey, 'as_of_date' AS name, 'As of ' || regexp_extract(x, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS matched, regexp_extract(x, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS value FROM t
UNION ALL SELECT o_orderkey, 'fiscal_year', regexp_extract(x, 'FY [0-9]{2}'), regexp_extract(x, 'FY ([0-9]{2})', 1) FROM t
UNION ALL SELECT o_orderkey, 'year_month', 'of ' || regexp_extract(x, 'of ([0-9]{4})', 1), 'of ' || regexp_extract(x, 'of ([0-9]{4})', 1) FROM t""")
def temporal_patterns(spark, sf):
    text = F.concat(F.lit("As of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", FY "), F.date_format("o_orderdate", "yy"))
    return table(spark, sf, "orders").select("o_orderkey", F.inline(T.temporal_patterns(text)))


@query("""SELECT o_orderkey, unnest(['scale', 'currency_code', 'unit']) AS name, unnest(['(in millions)', 'USD', 'kg']) AS matched, unnest(['millions', 'USD', 'kg']) AS value FROM orders
UNION ALL SELECT o_orderkey, 'currency_symbol', '€', '€' FROM orders WHERE o_orderkey % 3 = 0""")
def unit_patterns(spark, sf):
    text = F.concat(F.lit("(in millions) USD "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, " € 5 kg").otherwise(" 5 kg"))
    return table(spark, sf, "orders").select("o_orderkey", F.inline(T.unit_patterns(text)))


@query("""SELECT o_orderkey, '¹²' AS marker, 12::BIGINT AS number FROM orders UNION ALL SELECT o_orderkey, '[' || (o_orderkey % 9) || ']', (o_orderkey % 9)::BIGINT FROM orders UNION ALL SELECT o_orderkey, '**', NULL FROM orders""")
def footnote_markers(spark, sf):
    text = F.concat(F.lit("total¹² ["), (F.col("o_orderkey") % 9).cast("string"), F.lit("] **"))
    return table(spark, sf, "orders").select("o_orderkey", F.inline(T.footnote_markers(text)))


@query("SELECT c_custkey, round(c_acctbal, 2) AS value, floor(abs(c_acctbal))::BIGINT * CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS whole FROM customer")
def coerce_numbers(spark, sf):
    size = F.format_number(F.abs("c_acctbal"), 2)
    text = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), size, F.lit(") "))).otherwise(F.concat(F.lit(" $"), size))
    return table(spark, sf, "customer").select("c_custkey", V.coerce_number(text).alias("value"), V.coerce_number(text, "int").alias("whole"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN NULL ELSE false END AS flag FROM orders")
def coerce_bools(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "maybe").otherwise("f")
    return table(spark, sf, "orders").select("o_orderkey", V.coerce_bool(text).alias("flag"))


@query("""WITH o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM orders)
SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || format('{:,}', abs(v)) AS us, CASE WHEN v < 0 THEN '-' ELSE '' END || replace(format('{:,}', abs(v)), ',', '.') AS eu,
       CASE WHEN v < 0 THEN '(' || abs(v) || ')' ELSE v::VARCHAR END AS parens, CASE WHEN v < 0 THEN '-' ELSE '+' END || abs(v) AS signed, v::VARCHAR || '%' AS percent, CASE WHEN v < 0 THEN '-' ELSE '' END || format('{:,}', abs(v)) || '.00' AS cents FROM o""")
def format_numbers(spark, sf):
    v = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    o = table(spark, sf, "orders").select("o_orderkey", v.alias("v"))
    return o.select("o_orderkey", *[V.format_number("v", p).alias(n) for n, p in (("us", "#,###"), ("eu", "#.###"), ("parens", "(#)"), ("signed", "+#"), ("percent", "#%"), ("cents", "#,###.##"))])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%m/%Y') AS month, 'n/a' AS kept FROM orders")
def format_dates(spark, sf):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    return table(spark, sf, "orders").select("o_orderkey", V.format_date(day, "YYYY-MM-DD").alias("iso"), V.format_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "MM/YYYY").alias("month"), V.format_date(F.lit(" n/a "), "YYYY").alias("kept"))


@query("""SELECT p_partkey, upper(p_type) AS upper_case, replace(lower(p_type), ' ', '_') AS snake, replace(upper(p_type), ' ', '-') AS kebab FROM part""")
def string_cases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.format_text("p_type", "uppercase").alias("upper_case"), V.format_text("p_type", "snake_case").alias("snake"), V.format_text("p_type", "SCREAMING-KEBAB-CASE").alias("kebab"))


@query("""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, length(html) AS size FROM pages""")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))


# --- reports: render, parse, map, type ------------------------------------------------------

SHIPMENTS = Contract.of("""{"provider": "trade", "categories": {"shipments": ["nation", "shipment"]}, "outputs": {"shipments": {"category": "shipments", "schema": {"columns": [
 {"name": "nation", "type": "string", "aliases": ["Nation"]}, {"name": "flag", "type": "string", "aliases": ["A", "N", "R"]},
 {"name": "year", "type": "int", "aliases": ["1990", "1991", "1992", "1993", "1994", "1995", "1996", "1997", "1998", "1999", "2000", "2001", "2002", "2003", "2004", "2005", "2020", "2021", "2022", "2023", "2024", "2025"]},
 {"name": "quantity", "type": "float", "aliases": ["{YYYY}", "1990", "1991", "1992", "1993", "1994", "1995", "1996", "1997", "1998", "1999", "2000", "2001", "2002", "2003", "2004", "2005", "2020", "2021", "2022", "2023", "2024", "2025"]},
 {"name": "provider", "source": "constant", "value": "trade"}]}}}}""")


def shipments(spark, sf) -> DataFrame:
    """(region, nation, header, quantity) with headers `flag / year`."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", F.year("l_shipdate").alias("y"), F.col("l_quantity").cast("decimal(20,2)").alias("q"))
    s, n = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf, "nation")
    per = li.groupBy("l_suppkey", "l_returnflag", "y").agg(F.sum("q").alias("q"))  # before the joins
    j = per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_regionkey").alias("region"), F.col("n_name").alias("nation"), F.concat_ws(" / ", "l_returnflag", F.col("y").cast("string")).alias("header")).agg(F.sum("q").cast("long").alias("quantity"))


@query("""SELECT n_regionkey AS region, n_name AS nation, l_returnflag AS flag, year(l_shipdate)::BIGINT AS year, floor(sum(l_quantity::DECIMAL(20, 2)))::DOUBLE AS quantity, 'trade' AS provider
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def wide_report_roundtrip(spark, sf):
    """Flagship: totals as wide pipe tables per region, read back by a contract into typed long rows."""
    reports = P.render(shipments(spark, sf), "region", "nation", "header", "quantity", "Nation")
    return interpret(spark, reports, SHIPMENTS.outputs[0], "region").where("quantity is not null")


FLAGSHIP = wide_report_roundtrip


@query("""SELECT o_orderpriority AS label, o_orderstatus AS pivot_name, strftime(o_orderdate, '%Y') AS measure, count(*)::VARCHAR AS value FROM orders GROUP BY ALL""")
def unpivot_agnostic(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy").alias("y")).agg(F.count("*").alias("n"))
    rows = o.select(F.lit(1).alias("doc"), "o_orderpriority", F.concat_ws(" / ", "o_orderstatus", "y").alias("h"), "n")
    long = P.unpivot(P.parse(P.render(rows, "doc", "o_orderpriority", "h", "n", "Priority")))
    return long.where("value <> ''").select(F.col("shared")[0].alias("label"), "pivot_name", "measure", "value")


@query("""SELECT 'shipments' AS category, count(DISTINCT n_regionkey) AS reports FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def classify_reports(spark, sf):
    reports = P.render(shipments(spark, sf), "region", "nation", "header", "quantity", "Nation")
    head = P.title_tokens(F.substring_index("text", "\n", 1))
    return reports.select(P.classify(reports, F.array_join(head, " "), SHIPMENTS.categories).alias("category")).groupBy("category").agg(F.count("*").alias("reports"))


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY c_acctbal = max(c_acctbal) OVER (PARTITION BY c_nationkey)""")
def filter_latest(spark, sf):
    return O.latest(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], "c_acctbal")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey)""")
def filter_earliest(spark, sf):
    return O.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", earliest=True)


# --- downstream queries ---------------------------------------------------------------------


@query("""SELECT provider, count(*) AS n FROM (SELECT 'customer' AS provider FROM customer UNION ALL SELECT 'supplier' FROM supplier) GROUP BY provider""")
def count_by_provider(spark, sf):
    a, b = table(spark, sf, "customer").select(F.lit("customer").alias("provider")), table(spark, sf, "supplier").select(F.lit("supplier").alias("provider"))
    return a.unionByName(b).groupBy("provider").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT END)::BIGINT AS F, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT END)::BIGINT AS O FROM lineitem GROUP BY 1""")
def pivot_back_roundtrip(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum(F.col("l_quantity").cast("long")))


@query("""SELECT p_brand, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY total DESC, p_brand LIMIT 10""")
def top10_sum(spark, sf):
    per = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    j = per.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.sum("q").alias("total")).orderBy(F.desc("total"), "p_brand").limit(10)


@query("""SELECT r_name, count(n_name) AS n, coalesce(sum(n_nationkey), 0)::BIGINT AS keys FROM region LEFT JOIN nation ON contains(lower(n_name), lower(substr(r_name, 1, 2))) GROUP BY r_name""")
def contains_theta_join(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    j = r.join(n, F.contains(F.lower("n_name"), F.lower(F.substring("r_name", 1, 2))), "left")
    return j.groupBy("r_name").agg(F.count("n_name").alias("n"), F.coalesce(F.sum("n_nationkey"), F.lit(0)).cast("long").alias("keys"))


@query("""SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS draft, coalesce(s.n, 0) AS semantic FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""")
def draft_vs_semantic_counts(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("draft"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("semantic"))
    return c.join(s, "nation", "full_outer").na.fill(0, ["draft", "semantic"])


def _aliases(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    manual = n.where("n_regionkey <= 2").select(F.col("n_name").alias("alias")).unionByName(r.select(F.col("r_name").alias("alias")))
    return manual, n.where("n_regionkey >= 1").select(F.lower("n_name").alias("alias"))


_ALIASES = "WITH m AS (SELECT n_name AS alias FROM nation WHERE n_regionkey <= 2 UNION ALL SELECT r_name FROM region), r AS (SELECT lower(n_name) AS alias FROM nation WHERE n_regionkey >= 1) "


@query(_ALIASES + """SELECT coalesce(m.alias, r.alias) AS alias, CASE WHEN r.alias IS NULL THEN 'manual' WHEN m.alias IS NULL THEN 'resolved' ELSE 'both' END AS provenance FROM m FULL JOIN r ON lower(m.alias) = lower(r.alias)""")
def alias_provenance(spark, sf):
    manual, resolved = _aliases(spark, sf)
    return O.merge_aliases(manual, resolved, [])


@query(_ALIASES + """SELECT CASE WHEN r.alias IS NULL THEN 'manual_only' WHEN m.alias IS NULL THEN 'resolved_only' ELSE 'matched' END AS status, count(*) AS n FROM m FULL JOIN r ON lower(m.alias) = lower(r.alias) GROUP BY 1""")
def alias_diff(spark, sf):
    return O.diff_aliases(*_aliases(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier""")
def union_documents(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), allowMissingColumns=True)


@query("""SELECT n_name AS alias FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey <= 2)""")
def preflight_unmatched(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("alias"), "n_regionkey")
    return O.unmatched(n, n.where("n_regionkey <= 2"), "alias").select("alias")


@query("""SELECT avg(CASE WHEN n_regionkey <= 2 THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage FROM nation""")
def preflight_coverage(spark, sf):
    n = table(spark, sf, "nation")
    hit = n.join(F.broadcast(n.where("n_regionkey <= 2").select(F.col("n_name").alias("a"))), F.col("n_name") == F.col("a"), "left")
    return hit.agg(F.avg(F.col("a").isNotNull().cast("double")).alias("coverage"))


@query("""SELECT c_mktsegment AS segment, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AS is_valid, count(*) AS n FROM customer GROUP BY ALL""")
def validate_values(spark, sf):
    valid = spark.createDataFrame([("building",), (" Machinery ",), ("FURNITURE",)], "v string")
    out = O.check_values(table(spark, sf, "customer"), "c_mktsegment", valid, "v")
    return out.groupBy(F.col("c_mktsegment").alias("segment"), "is_valid").agg(F.count("*").alias("n"))


# --- layout ---------------------------------------------------------------------------------


@query("""WITH x AS (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag || l_linestatus ELSE '' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM x""")
def forward_fill_headers(spark, sf):
    cell = F.when(F.col("l_linenumber") % 2 == 1, F.concat("l_returnflag", "l_linestatus")).otherwise("")
    x = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"), cell.alias("v"))
    return G.forward_fill(x, ["l_orderkey"], "o", "v", "filled").select("l_orderkey", "l_linenumber", "l_partkey", "filled")


@query("""WITH e AS (SELECT user_id, epoch(ts)::BIGINT AS s FROM events), m AS (SELECT user_id, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 3600 THEN 1 ELSE 0 END AS new FROM e)
SELECT user_id, sum(new)::BIGINT + 1 AS clusters FROM m GROUP BY user_id""")
def gap_clusters(spark, sf):
    since = "cast(cast(ts AS timestamp_ntz) - timestamp_ntz'1970-01-01' AS interval second)"
    e = table(spark, sf, "events").select("user_id", F.expr(f"bround(cast({since} AS decimal(20, 6)))").cast("long").alias("s"))  # to the nearest second, halves to even
    return G.islands(e, ["user_id"], "s", 3600).groupBy("user_id").agg((F.max("cluster") + 1).cast("long").alias("clusters"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, n FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) = 1""")
def mode_first_tie(spark, sf):
    return G.mode_first(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey", "c_mktsegment")


@query("""SELECT c_nationkey, c_acctbal AS median FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) = count(*) OVER (PARTITION BY c_nationkey) // 2 + 1""")
def upper_median(spark, sf):
    return G.upper_median(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", "median")


@query("""WITH x AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_returnflag <> lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) THEN 1 ELSE 0 END AS c FROM lineitem)
SELECT l_orderkey, sum(c)::BIGINT AS changes, count(DISTINCT l_returnflag) AS colors, sum(c) >= 4 AND count(DISTINCT l_returnflag) = 2 AS is_zebra FROM x GROUP BY 1""")
def zebra_detect(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return G.zebra(rows, ["l_orderkey"], "o", "l_returnflag")


@query("""WITH s AS (SELECT n_nationkey, n_nationkey * 3 AS lo, n_nationkey * 3 + 7 AS hi FROM nation), c AS (SELECT r_regionkey AS col_idx, r_regionkey * 15 AS col_lo, r_regionkey * 15 + 12 AS col_hi FROM region)
SELECT n_nationkey, col_idx, greatest(least(hi, col_hi) - greatest(lo, col_lo), 0) AS overlap FROM s, c
QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY greatest(least(hi, col_hi) - greatest(lo, col_lo), 0) DESC, abs((lo + hi) / 2 - (col_lo + col_hi) / 2), col_idx) = 1""")
def header_overlap_join(spark, sf):
    s = table(spark, sf, "nation").select(F.lit(1).alias("page"), "n_nationkey", (F.col("n_nationkey") * 3).alias("lo"), (F.col("n_nationkey") * 3 + 7).alias("hi"))
    c = table(spark, sf, "region").select(F.lit(1).alias("page"), F.col("r_regionkey").alias("col_idx"), (F.col("r_regionkey") * 15).alias("col_lo"), (F.col("r_regionkey") * 15 + 12).alias("col_hi"))
    return G.header_overlap(s, c, ["page"]).select("n_nationkey", "col_idx", "overlap")


@query("""WITH s AS (SELECT n_nationkey, n_nationkey * 3 AS x FROM nation) SELECT n_nationkey, r_regionkey * 16 AS column_start, abs(x - r_regionkey * 16) <= 4 AS within FROM s, region
QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(x - r_regionkey * 16), r_regionkey) = 1""")
def nearest_column_join(spark, sf):
    s = table(spark, sf, "nation").select(F.lit(1).alias("page"), "n_nationkey", (F.col("n_nationkey") * 3).alias("x"))
    c = table(spark, sf, "region").select(F.lit(1).alias("page"), (F.col("r_regionkey") * 16).alias("start"))
    return G.nearest_column(s, c, ["page"], "x", "start", 4).select("n_nationkey", "column_start", "within")


# --- vocabularies and records ---------------------------------------------------------------


@query("""SELECT 'r' || r_regionkey AS concept, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation""")
def narrower_recursive(spark, sf):
    triples = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("broader"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("narrower"))
    return O.narrower(triples, table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("concept")), 3)


@query("""SELECT upper(n_name) AS label, n_nationkey AS concept, 'ok' AS status FROM nation UNION ALL SELECT 'NOWHERE', NULL, 'missing'""")
def label_lookup(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept"), F.lower("n_name").alias("label"))
    wanted = n.select(F.upper("label").alias("label")).unionByName(spark.createDataFrame([("NOWHERE",)], "label string"))
    return O.lookup(n, wanted)


@query("""SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2""")
def geo_enumerate(spark, sf):
    r = table(spark, sf, "region").where("r_regionkey = 2")
    return table(spark, sf, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query("""SELECT o_orderkey::VARCHAR AS subject, 'o_custkey' AS predicate, o_custkey::VARCHAR AS object, 'xsd:integer' AS datatype FROM orders UNION ALL SELECT o_orderkey::VARCHAR, 'o_orderstatus', o_orderstatus, 'xsd:string' FROM orders WHERE o_orderstatus <> ''""")
def records_to_triples(spark, sf):
    return O.to_triples(table(spark, sf, "orders"), "o_orderkey", {"o_custkey": "xsd:integer", "o_orderstatus": "xsd:string"})


@query("""SELECT o_orderkey AS subject, 'min' AS "constraint" FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, 'in' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def shape_check(spark, sf):
    return O.shape_violations(table(spark, sf, "orders"), "o_orderkey", {"min": F.col("o_totalprice") >= 50000, "in": F.col("o_orderstatus").isin("F", "O")})


@query("""SELECT (SELECT count(*) FROM part) AS total, 'p_brand' AS "column", count(p_brand) AS non_null, count(DISTINCT p_brand) AS distinct_values, min(p_brand) AS smallest, max(p_brand) AS largest FROM part
UNION ALL SELECT (SELECT count(*) FROM part), 'p_size', count(p_size), count(DISTINCT p_size), min(p_size::VARCHAR), max(p_size::VARCHAR) FROM part""")
def column_profile(spark, sf):
    return O.profile(table(spark, sf, "part"), ["p_brand", "p_size"])


# --- streaming plans on a batch -------------------------------------------------------------


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_events(spark, sf):
    return S.deduplicated(table(spark, sf, "events").select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark, sf):
    return S.tumbling(table(spark, sf, "events"), "1 hour", ["event_type"])


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(spark, sf):
    return S.sessions(table(spark, sf, "events"), "30 minutes", "user_id")


# --- sections, transposed tables, titles, metadata ------------------------------------------


@query("""SELECT r_name AS section, n_name AS nation, n_nationkey::VARCHAR AS key FROM nation JOIN region ON n_regionkey = r_regionkey""")
def unpivot_with_sections(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.struct("n_name", T.pipe_row(F.array("n_name", F.col("n_nationkey").cast("string"))).alias("t"))
    part = n.groupBy("r_name").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    block = F.concat_ws("\n", F.concat(F.lit("**"), "r_name", F.lit("**")), F.lit("| Nation | Key |"), F.transform("rows", lambda r: r["t"]))
    text = part.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_name", block.alias("t")))), lambda s: s["t"]), "\n").alias("text")).withColumn("doc", F.lit(1))
    rows = P.parse_sections(text, "doc")
    return rows.select("section", F.col("cells")[0].alias("nation"), F.col("cells")[1].alias("key"))


@query("""SELECT r_name AS region, count(*)::VARCHAR AS nations, sum(n_nationkey)::VARCHAR AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def transposed_report(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    per = n.groupBy("n_regionkey", "r_name").agg(F.count("*").cast("string").alias("c"), F.sum("n_nationkey").cast("string").alias("s"))
    row = lambda label, c: T.pipe_row(F.array(F.lit(label), F.col(c)))
    docs = per.select(F.col("n_regionkey").alias("doc"), F.concat_ws("\n", row("Region name", "r_name"), F.lit("|---|---|"), row("Number of nations", "c"), row("Key sum", "s")).alias("text"))
    aliases = spark.createDataFrame([("region NAME", "region"), ("Number of nations", "nations"), ("key  sum", "keys")], "alias string, column string")
    return P.map_transposed(P.parse(docs).drop("title"), aliases, ["region", "nations", "keys"]).select("region", "nations", "keys")


@query()
def fuzzy_title_join(spark, sf):
    """Titles of parts and nations, some misspelt or with words around, against all nations' names at the production threshold."""
    n = table(spark, sf, "nation")
    terms = [r["n_name"] for r in n.orderBy("n_nationkey").collect()]  # a title filter's terms
    parts = table(spark, sf, "part").join(n, F.col("p_partkey") % 25 == F.col("n_nationkey"))
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("Exports of "), "n_name", F.lit(" by month"))).when(k == 2, F.concat(F.substring("n_name", 1, 3), F.substring("n_name", 5, 20))).otherwise(F.col("p_name"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    titles = parts.select("p_partkey", title.alias("title")).repartition(tasks)  # a small file is one task's, its titles are not
    hit = titles.withColumn("b", best_term(F.col("title"), terms, 90.0))
    return hit.where("b.term is not null").select("p_partkey", "title", "b.term", "b.score")


META = [Field("contact", patterns=(r"([0-9a-z._]+@[a-z0-9.]+)",)), Field("licence", category_patterns=(r"(?i)licensed under the ([A-Z][A-Za-z ]+?)(?:,|\.)",), default="unknown"), Field("none", patterns=(r"\bnever-there-\d\b",), required=True)]


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM s),
c AS (SELECT doc_id, regexp_extract(line, '([0-9a-z._]+@[a-z0-9.]+)', 1) AS v, i FROM l WHERE regexp_matches(line, '([0-9a-z._]+@[a-z0-9.]+)')),
k AS (SELECT doc_id, regexp_extract(line, '(?i)licensed under the ([A-Z][A-Za-z ]+?)(?:,|\\.)', 1) AS v, i FROM l WHERE regexp_matches(line, '(?i)licensed under the ([A-Z][A-Za-z ]+?)(?:,|\\.)'))
SELECT doc_id, 'contact' AS field, first(v ORDER BY i) AS value, CASE WHEN first(v ORDER BY i) IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, false AS is_missing FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id
UNION ALL SELECT doc_id, 'licence', coalesce(first(v ORDER BY i), 'unknown'), CASE WHEN first(v ORDER BY i) IS NULL THEN 0.5 ELSE 0.7 END, false FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id
UNION ALL SELECT doc_id, 'none', NULL, 0.0, true FROM documents""")
def metadata_quick_scan(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("page_no"), F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    lines = lines.select("doc_id", "page_no", ((F.col("i") + 0.5) / F.col("n")).alias("y"), "text")
    return with_fallbacks(quick_scan(lines, "doc_id", META), "doc_id", META)


# --- layout, sheets and drafting ------------------------------------------------------------


def _spans(spark, sf):
    """Line items as text spans: an order is a page, its flags and parts stand at made-up positions."""
    n, q, text = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.concat("l_returnflag", F.col("l_partkey").cast("string"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.lit(0).alias("page_no"), (n * 40.5).alias("x"), (q % 9 * 2.5).alias("y"),
        (F.length(text) * (5.0 + n % 2)).alias("width"), text.alias("text"), n.alias("n"),
    )


_SPANS = """s AS (SELECT l_orderkey AS doc, l_linenumber * 40.5::DOUBLE AS x, (l_quantity::INT % 9) * 2.5::DOUBLE AS y, length(l_returnflag || l_partkey) * (5.0::DOUBLE + l_linenumber % 2) AS width, l_returnflag || l_partkey AS text, l_linenumber AS n FROM lineitem),
p AS (SELECT doc, median(width / length(text)) AS cell_w, min(x) AS x_min FROM s GROUP BY doc),
d AS (SELECT doc, y, CASE WHEN y - lag(y) OVER (PARTITION BY doc ORDER BY y) > 4 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc, y FROM s)),
r AS (SELECT doc, y, sum(new) OVER (PARTITION BY doc ORDER BY y) AS "row" FROM d),
l AS (SELECT doc, n, text, "row"::INT AS "row", round_even((x - x_min) / cell_w, 0)::INT AS col FROM s JOIN r USING (doc, y) JOIN p USING (doc))"""


@query(f"""WITH {_SPANS} SELECT doc, n, text, "row", col FROM l""")
def page_layout(spark, sf):
    return L.page_layout(_spans(spark, sf), 4.0).select("doc", "n", "text", "row", "col")


@query(f"""WITH {_SPANS}, k AS (SELECT doc, "row", count(*) AS n, min(col) AS first FROM l GROUP BY ALL), c AS (SELECT doc, count(DISTINCT col) AS n_columns FROM l GROUP BY doc)
SELECT doc, count(*) >= 3 AND any_value(n_columns) <= 5 AND var_pop(n) <= 2.0 AND avg((first <= 3)::INT) >= 0.8 AS is_transposed FROM k JOIN c USING (doc) GROUP BY doc""")
def transposed_test(spark, sf):
    return L.transposed(L.page_layout(_spans(spark, sf), 4.0)).select("doc", "is_transposed")


@query()
def page_regions(spark, sf):
    return L.regions(L.page_layout(_spans(spark, sf), 4.0)).drop("page_no")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS doc, floor(o_totalprice)::BIGINT AS start FROM orders), g AS (SELECT *, start - lag(start) OVER (PARTITION BY doc ORDER BY start) AS gap FROM c),
m AS (SELECT doc, gap AS mid FROM g WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY gap) = count(*) OVER (PARTITION BY doc) // 2 + 1)
SELECT doc, start, sum(CASE WHEN gap > 3.0 * mid THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY start)::BIGINT AS grid FROM g LEFT JOIN m USING (doc)""")
def side_by_side(spark, sf):
    starts = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.floor("o_totalprice").alias("start")).distinct()
    return L.side_by_side(starts, ["doc"]).withColumn("grid", F.col("grid").cast("bigint"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (l_linenumber & 16) <> 0 OR l_returnflag = 'R' AS is_bold, (l_linenumber & 1) <> 0 AS is_italic, CASE WHEN l_partkey <> 0 THEN ((l_partkey >> 8) & 255) / 255.0::DOUBLE END AS green FROM lineitem""")
def font_flags(spark, sf):
    spans = table(spark, sf, "lineitem").withColumns({"font": F.when(F.col("l_returnflag") == "R", "Sans-Black").otherwise("Sans"), "flags": F.col("l_linenumber").cast("int"), "color": F.col("l_partkey").cast("int")})
    return L.decode_fonts(spans).select("l_orderkey", "l_linenumber", "l_partkey", "is_bold", "is_italic", F.col("rgb.g").alias("green"))


@query()
def font_size_tiers(spark, sf):
    return L.size_tiers(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("size")), ["doc"])


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS w, l_linenumber::DOUBLE AS h, l_returnflag = 'A' AS stroke FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN stroke AND w > h THEN 'h' WHEN stroke THEN 'v' WHEN h < 2 AND w > 5 * h THEN 'h' WHEN w < 2 AND h > 5 * w THEN 'v' ELSE 'fill' END AS kind FROM d""")
def drawing_kinds(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "s").otherwise("f").alias("type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        F.col("l_quantity").cast("double").alias("x1"), F.col("l_linenumber").cast("double").alias("y1"), F.lit(1.0).alias("stroke"),
    )
    return L.classify_drawings(d).select("l_orderkey", "l_linenumber", "l_partkey", "kind")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS t, o_orderkey // 8 AS r FROM orders), g AS (SELECT t, r, CASE WHEN r - lag(r) OVER (PARTITION BY t ORDER BY r) > 200 THEN 1 ELSE 0 END AS new FROM c),
b AS (SELECT t, r, sum(new) OVER (PARTITION BY t ORDER BY r) AS band FROM g), z AS (SELECT t, band, max(r) - min(r) + 1 AS h, count(*) AS n FROM b GROUP BY ALL),
k AS (SELECT t, n, row_number() OVER (PARTITION BY t ORDER BY band) - 1 AS region FROM z WHERE h >= 2)
SELECT t, region::BIGINT AS region, n * 2 AS cells FROM k UNION ALL SELECT t, 0, sum(n)::BIGINT * 2 FROM z WHERE t NOT IN (SELECT t FROM k) GROUP BY t""")
def blank_run_regions(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("t"), F.expr("o_orderkey div 8").alias("row")).distinct()
    cells = rows.select("t", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("col"), F.lit("x").alias("text"))
    return X.regions(cells, ["t"], gap_rows=200).groupBy("t", F.col("region").cast("bigint").alias("region")).agg(F.count("*").alias("cells"))


@query("""WITH c AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1) SELECT o_custkey, count(*) AS kept FROM orders JOIN c USING (o_custkey) WHERE NOT (o_orderkey = last AND o_orderstatus = 'F') GROUP BY 1""")
def totals_row_drop(spark, sf):
    word = F.when(F.col("o_orderstatus") == "F", " Total ").otherwise("row")
    cells = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("row"), F.lit(0).alias("col"), word.alias("text"), F.lit(True).alias("bold"))
    return X.drop_totals(cells, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("kept"))


@query("""WITH h AS (SELECT DISTINCT o_custkey AS t, o_orderkey AS r, o_orderstatus AS v FROM orders), k AS (SELECT t, r, v, lag(v) OVER (PARTITION BY t ORDER BY r) AS before FROM h)
SELECT t, string_agg(v, ' / ' ORDER BY r) AS header FROM k WHERE before IS NULL OR before <> v GROUP BY t""")
def dedupe_fragments(spark, sf):
    cells = table(spark, sf, "orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("row"), F.lit(0).alias("col"), F.col("o_orderstatus").alias("text"))
    return G.compound_headers(cells, "t", "row", "col", "text").select("t", "header")


@query("""SELECT o_custkey AS t, coalesce(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 0) AS header_rows FROM orders GROUP BY 1""")
def header_row_estimate(spark, sf):
    number = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).otherwise("none")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("t"), F.col("o_orderkey").alias("row"), F.array("o_orderstatus", number).alias("cells"))
    return G.header_length(rows, "t", "row", "cells")


@query("""WITH v AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT o_custkey, n, count(*) AS seen FROM v JOIN orders ON l_orderkey = o_orderkey WHERE n >= 2 GROUP BY ALL)
SELECT o_custkey, n, seen FROM k WHERE seen >= 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY seen DESC, n) <= 3""")
def top3_counts(spark, sf):
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    return G.top_counts(v.join(o, "l_orderkey"), ["o_custkey"], "n", 3)


_KIND = """CASE WHEN regexp_full_match(v, '[0-9]{4}') THEN 'date' WHEN regexp_full_match(v, '-?[0-9]+(\\.[0-9]+)?') THEN 'number' ELSE 'string' END"""


@query(f"""WITH c AS (SELECT 'customer' AS t, unnest(['c_custkey', 'c_nationkey', 'c_mktsegment', 'c_name']) AS col, unnest([c_custkey::VARCHAR, c_nationkey::VARCHAR, c_mktsegment, c_name]) AS v FROM customer),
k AS (SELECT t, col, v, {_KIND} AS kind FROM c), m AS (SELECT t, col, kind, count(*) AS n FROM k GROUP BY ALL),
a AS (SELECT t, col, count(*) AS n, count(DISTINCT v) AS distinct_values, bool_or(kind = 'string') AS texts FROM k GROUP BY ALL)
SELECT t, col, CASE WHEN texts AND n >= 3 AND (distinct_values <= 5 OR distinct_values <= 0.1 * n) THEN 'enum' ELSE (SELECT arg_max(kind, m.n) FROM m WHERE m.t = a.t AND m.col = a.col) END AS type, n, distinct_values FROM a""")
def column_types(spark, sf):
    names = ["c_custkey", "c_nationkey", "c_mktsegment", "c_name"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("col"), F.col(n).cast("string").alias("text")) for n in names])).alias("p")
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), pairs).select(F.lit("customer").alias("t"), "row", "p.col", "p.text")
    return D.column_types(cells, ["t", "col"])


@query()
def group_similar_tables(spark, sf):
    word = F.concat("l_returnflag", (F.col("l_suppkey") % 4).cast("string"))
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(word).alias("tokens"), F.countDistinct("l_linenumber").alias("n_cols"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("l_orderkey"))
    return D.group_similar(t.join(o, "l_orderkey"), "batch", "l_orderkey")


@query("""WITH w AS (SELECT lang, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM c), f AS (SELECT k.* FROM k JOIN (SELECT lang, count(*) AS m FROM documents GROUP BY 1) USING (lang) WHERE place <= 20 AND n >= greatest(1, 0.3 * m) AND length(word) > 2 AND word NOT IN ('"""
       + "', '".join(D.STOP_WORDS)
       + """'))
SELECT lang, word AS keyword, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM f) WHERE rank <= 10""")
def group_keywords(spark, sf):
    t = table(spark, sf, "documents").select("lang", F.split(F.lower("text"), " ").alias("tokens"), F.lit(None).cast("string").alias("title"))
    return D.keywords(t, "lang")


@query("""SELECT c_custkey, coalesce(e.n_nationkey, f.n_nationkey) AS column, e.n_nationkey IS NOT NULL AS exact FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(n_name) WHEN c_custkey % 3 = 1 THEN lower(n_name) || ', total' ELSE 'none' END AS h FROM customer JOIN nation ON c_nationkey = n_nationkey)
LEFT JOIN nation e ON h = lower(e.n_name) LEFT JOIN nation f ON split_part(h, ',', 1) = lower(f.n_name)""")
def alias_comma_fallback(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    h = c.select("c_custkey", F.when(k == 0, F.col("n_name")).when(k == 1, F.concat("n_name", F.lit(", Total"))).otherwise("none").alias("header"))
    return O.match_headers(h, n.select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("column"))).select("c_custkey", "column", "exact")


@query("""SELECT n_nationkey AS concept, n_name AS label, 'en' AS lang, 'pref' AS kind FROM nation""")
def concept_labels(spark, sf):
    n = table(spark, sf, "nation")
    names = n.select(F.col("n_nationkey").alias("concept"), "n_name", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("lang"))
    names = names.select("concept", F.col("n_name").alias("label"), "lang", F.explode(F.array(F.lit("pref"), F.lit("alt"))).alias("kind"))
    return O.labels(n.select(F.col("n_nationkey").alias("concept")), names, ["en"], ["pref"]).select("concept", "label", "lang", "kind")


from . import queries_documents  # noqa: E402, F401  (registers its queries)
