"""Registered queries over documents of tables: pivots, mapping, whole contracts, predicates on rows, batches, geography, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import grid as G
from .operators import layout as L
from .operators import ontology as O
from .operators import pivot as PV
from .operators import rows as R
from .operators import sheets as X
from .operators import tables as P
from .operators.fuzzy import suggestions
from .plans import documents as D
from .plans.contract import Contract
from .plans.mapping import mapped_rows
from .queries import query
from .session import table

# --- pivots ---------------------------------------------------------------------------------


def _pivoted(spark, sf):
    """One pipe table: priorities by status, where each status spells its two measures in its own way."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice")).cast("long").alias("v"))
    end = F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "O", "s").otherwise("ed")
    cell = lambda name, c: F.struct(F.concat(F.col("o_orderstatus"), F.lit(f" / {name}"), end).alias("h"), F.col(c).alias("v"))
    one = o.select(F.lit(1).alias("doc"), "o_orderpriority", F.explode(F.array(cell("Order count", "n"), cell("Total price", "v"))).alias("c"))
    return P.render(one.select("doc", "o_orderpriority", "c.h", "c.v"), "doc", "o_orderpriority", "h", "v", "Priority")


_PIVOTED = """SELECT o_orderpriority AS priority, o_orderstatus AS pivot_name, count(*)::VARCHAR AS "count", sum(round(o_totalprice))::BIGINT::VARCHAR AS price, 'Order count' AS measure FROM orders GROUP BY ALL"""


@query(_PIVOTED)
def unpivot_general(spark, sf):
    rows = PV.unpivot_detected(P.parse(_pivoted(spark, sf)))
    return rows.select(F.col("cells")[0].alias("priority"), "pivot_name", F.col("cells")[1].alias("count"), F.col("cells")[2].alias("price"), F.col("headers")[1].alias("measure"))


@query(_PIVOTED)
def unpivot_text_reports(spark, sf):
    rows = P.parse(PV.unpivot_text(_pivoted(spark, sf)).where("was_transformed").select("doc", "text"))
    return rows.select(F.col("cells")[1].alias("priority"), F.col("cells")[0].alias("pivot_name"), F.col("cells")[2].alias("count"), F.col("cells")[3].alias("price"), F.col("headers")[2].alias("measure"))


@query("""SELECT DISTINCT o_orderstatus AS prefix, 'Order count, Total price' AS measures, 2 * dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS "first", 0 AS shared FROM orders""")
def detect_pivot_reports(spark, sf):
    heads = P.parse(_pivoted(spark, sf)).select("headers").distinct().select(PV.detect_pivot("headers").alias("p"))
    return heads.select(F.explode("p.groups").alias("g"), F.array_join("p.measures", ", ").alias("measures"), F.col("p.shared")[0].alias("shared")).select(
        F.col("g.prefix").alias("prefix"), "measures", F.col("g.cols")[0].cast("long").alias("first"), "shared"
    )


# --- mapping and contracts ------------------------------------------------------------------


@query("""SELECT r_name AS region, n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2)::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def mapping_fallbacks(spark, sf):
    """Region from the title, nation from the column without a header, the count by a joined header, the balance before a comma."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("b"))
    line = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", F.struct("n_name", T.pipe_row(F.array("n_name", F.col("n").cast("string"), F.col("b").cast("string"), F.lit("-"))).alias("t")).alias("r"))
    doc = line.groupBy("r_name").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    head = F.concat(F.lit("## Customers of "), "r_name", F.lit("\n|  | Customer / count | Account balance, USD | Remark |\n|---|---|---|---|\n"))
    docs = doc.select("r_name", F.concat(head, F.array_join(F.transform("rows", lambda r: r["t"]), "\n")).alias("text"))
    regions = [r["r_name"] for r in table(spark, sf, "region").collect()]  # the contract's aliases
    columns = [("region", "string", regions), ("nation", "string", ["Nation"]), ("customers", "int", ["customer count"]), ("balance", "float", ["Account balance"])]
    out = mapped_rows(docs, columns)
    return out.select(F.col("r_name").alias("region"), "nation", V.coerce_number("customers", "int").cast("long").alias("customers"), V.coerce_number("balance", "float").alias("balance")).where(F.col("title").contains(F.col("r_name")))


@query("""SELECT o_orderpriority AS section, o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY ALL""")
def mapping_sections(spark, sf):
    """Section labels of a table fill the column whose aliases they are."""
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("string").alias("n"))
    part = o.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(T.pipe_row(F.array("o_orderstatus", "n")))).alias("rows"))
    block = F.concat(F.lit("**"), "o_orderpriority", F.lit("**\n"), F.array_join("rows", "\n"))
    text = part.agg(F.concat(F.lit("| Status | Orders |\n|---|---|\n"), F.array_join(F.array_sort(F.collect_list(block)), "\n")).alias("text")).withColumn("doc", F.lit(1))
    labels = [r[0] for r in o.select("o_orderpriority").distinct().collect()]  # the contract's aliases
    out = mapped_rows(text, [("section", "string", labels), ("status", "string", ["Status"]), ("orders", "int", ["Orders"])])
    return out.select("section", "status", V.coerce_number("orders", "int").cast("long").alias("orders"))


CONTRACT = Contract.of(
    """{"provider": "demo", "categories": {"balances": {"keywords": ["account balance"]}, "deliveries": {"keywords": ["delivery", "supplier"]}}, "outputs": {
 "balances": {"category": "balances", "schema": {"columns": [{"name": "key", "aliases": ["Nation"]}, {"name": "value", "type": "float", "aliases": ["Account balance"]}, {"name": "day", "source": "report_date"}]}},
 "deliveries": {"category": "deliveries", "schema": {"columns": [{"name": "key", "aliases": ["Supplier nation"]}, {"name": "value", "type": "int", "aliases": ["{YYYY}"]}, {"name": "day", "source": "report_date"}]}}}}"""
)


def _region_documents(spark, sf):
    """A document for each region: a page of balances, a blank one, one of two tables of suppliers."""
    n = table(spark, sf, "nation")
    bal = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("string").alias("v"))
    sup = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").cast("string").alias("s"))
    all_ = n.join(bal, F.col("n_nationkey") == F.col("c_nationkey")).join(sup, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    row = lambda v: T.pipe_row(F.array("n_name", v))
    per = all_.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row("v"))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), row("s")))).alias("b"))
    first = F.concat(F.lit("## Customers\n| Nation | Account balance |\n|---|---|\n"), F.array_join("a", "\n"))
    last = F.concat(F.lit("| Supplier nation | 2024 |\n|---|---|\n"), F.array_join("b", "\n"), F.lit("\n\n| Note |\n|---|\n| none |"))
    path = F.concat(F.lit("/in/report 2024-0"), (F.col("n_regionkey") + 1).cast("string"), F.lit("-15 final.txt"))
    return per.select(F.col("n_regionkey").alias("doc"), path.alias("path"), F.concat_ws("\f", first, F.lit(" \n "), last).alias("text"))


@query("""WITH d AS (SELECT n_nationkey, n_name, n_regionkey, '2024-0' || (n_regionkey + 1) || '-15' AS day FROM nation)
SELECT n_regionkey AS doc, 'balances' AS output, 0 AS page_no, n_name AS key, round(sum(c_acctbal), 2)::DOUBLE AS value, day FROM d JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT n_regionkey, 'deliveries', 2, n_name, count(*)::DOUBLE, day FROM d JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY ALL""")
def run_contract_documents(spark, sf):
    """Pages, tables, categories, mapping, years, report dates and outputs of a contract over all documents."""
    frames = D.run_contract(spark, _region_documents(spark, sf), CONTRACT, date=D.report_date("filename", "path"))
    return D.concat([df.select("doc", F.lit(name).alias("output"), "page_no", "key", F.col("value").cast("double").alias("value"), "day") for name, df in frames.items()])


@query("""SELECT n_regionkey AS doc, 0 AS page_no, 0 AS table_idx, count(DISTINCT n_nationkey) AS n_rows, 2 AS n_cols FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) GROUP BY ALL
UNION ALL SELECT n_regionkey, 2, 0, count(DISTINCT n_nationkey), 2 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY ALL
UNION ALL SELECT DISTINCT n_regionkey, 2, 1, 1, 1 FROM nation""")
def document_tables(spark, sf):
    return D.split_tables(D.split_pages(_region_documents(spark, sf).drop("path"))).select("doc", "page_no", "table_idx", F.col("n_rows").cast("long").alias("n_rows"), "n_cols")


@query("""SELECT n_regionkey AS doc, 2 AS page, CASE WHEN n_regionkey % 2 = 0 THEN true ELSE false END AS even FROM (SELECT DISTINCT n_regionkey FROM nation)""")
def select_document_pages(spark, sf):
    pages = D.select_numbers(D.split_pages(_region_documents(spark, sf)), "page_no", [2, 7]).withColumn("even", F.col("doc") % 2 == 0)
    return D.with_page(pages, ["doc", "even", "absent"])


def _tables(spark, sf):
    """A table for each nation: named after what it is for some, of like headers for others."""
    k = F.col("n_nationkey") % 4
    heads = F.when(k == 0, F.array(F.lit("Vessel name"), F.lit("Tonnes loaded"))).when(k == 1, F.array(F.lit("Name"), F.lit("Tonnes loaded"))).when(k == 2, F.array(F.lit("Harvested area"))).otherwise(F.array(*[F.lit(x) for x in "pqrstu"]))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("doc"), F.lit(0).alias("table_idx"), F.when(k == 0, "Shipping").alias("title"), heads.alias("headers"), (F.col("n_nationkey") % 5).cast("int").alias("n_rows"), F.size(heads).alias("n_cols"))


_CATS = {"ships": ["vessel"], "crops": ["harvest"]}


@query("""SELECT n_nationkey AS doc, CASE WHEN n_nationkey % 5 < 1 THEN 'other' WHEN n_nationkey % 4 = 0 THEN 'ships' WHEN n_nationkey % 4 = 2 THEN 'crops' ELSE 'other' END AS keyword_only,
CASE n_nationkey % 4 WHEN 0 THEN 'ships' WHEN 1 THEN 'ships' WHEN 2 THEN 'crops' ELSE 'other' END AS propagated FROM nation""")
def classify_by_similarity(spark, sf):
    a = D.classify_tables(_tables(spark, sf), _CATS, min_rows=1).select("doc", F.col("category").alias("keyword_only"))
    b = D.classify_tables(_tables(spark, sf), _CATS, min_rows=1, propagate=True).select("doc", F.col("category").alias("propagated"))
    return a.join(b, "doc")


@query("""SELECT 'ships' AS category, count(*) FILTER (n_nationkey % 4 = 0) AS n, 2.0::DOUBLE AS mean_cols, 'loaded name shipping tonnes vessel' AS tokens FROM nation
UNION ALL SELECT 'crops', count(*) FILTER (n_nationkey % 4 = 2), 1.0, 'area harvested' FROM nation""")
def category_profiles(spark, sf):
    return D.category_profiles(D.classify_tables(_tables(spark, sf), _CATS)).select("category", "n", "mean_cols", F.array_join("tokens", " ").alias("tokens"))


@query("""SELECT n_nationkey AS doc, CASE n_nationkey % 4 WHEN 0 THEN 'vessels' ELSE 'harvest' END AS output FROM nation WHERE n_nationkey % 2 = 0""")
def route_tables(spark, sf):
    outs = Contract.of("""{"outputs": {"vessels": {"category": "ships", "schema": {"columns": []}}, "harvest": {"category": "crops", "schema": {"columns": []}}}}""").outputs
    return D.route(D.classify_tables(_tables(spark, sf), _CATS), outs, "doc").select("doc", "output")


# --- rows, cells and headers ----------------------------------------------------------------

_TEXTS = """CASE p_partkey % 9 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'Includes ' || p_name WHEN 2 THEN '(' || p_name || ')' WHEN 3 THEN upper(p_name) WHEN 4 THEN 'Note: ' || p_name WHEN 5 THEN p_size || ',000.5 %' WHEN 6 THEN ' ' WHEN 7 THEN p_name ELSE '***' END"""


@query(f"""WITH t AS (SELECT p_partkey, {_TEXTS} AS x FROM part) SELECT p_partkey, regexp_matches(trim(x), '^([0-9]+$|[Ii][Nn][Cc][Ll][Uu][Dd][Ee][Ss]\\b|\\*+$|[Nn][Oo][Tt][Ee]:)') AS footnote,
trim(x) = '' OR (trim(x) LIKE '(%' AND trim(x) LIKE '%)') OR regexp_full_match(regexp_replace(trim(x), '[ ,._$€£%+-]', '', 'g'), '[0-9]+') AS continuation,
NOT contains(x, ':') AND length(trim(x)) > 3 AND x = upper(x) AND x <> lower(x) AS section_label FROM t""")
def row_text_predicates(spark, sf):
    n, s, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 9
    cases = [s, F.concat(F.lit("Includes "), n), F.concat(F.lit("("), n, F.lit(")")), F.upper(n), F.concat(F.lit("Note: "), n), F.concat(s, F.lit(",000.5 %")), F.lit(" "), n, F.lit("***")]
    x = F.coalesce(*[F.when(k == i, c) for i, c in enumerate(cases)])
    t = table(spark, sf, "part").select("p_partkey", x.alias("x"))
    return t.select("p_partkey", R.is_footnote("x").alias("footnote"), R.is_continuation("x").alias("continuation"), R.is_section_label("x").alias("section_label"))


@query("""SELECT p_partkey, p_size < 25 OR p_partkey % 2 = 0 AS header_like, p_size < 25 AND p_partkey % 2 = 0 AS text_row, false AS blank_row FROM part""")
def row_array_predicates(spark, sf):
    """Cells of a part: a name, a size or its name, a year or its brand."""
    cells = F.array("p_name", F.when(F.col("p_size") < 25, F.col("p_type")).otherwise(F.col("p_size").cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise((F.col("p_size") + 300).cast("string")))
    t = table(spark, sf, "part").select("p_partkey", cells.alias("c"))
    return t.select("p_partkey", R.is_header_like("c").alias("header_like"), R.is_text_row("c").alias("text_row"), R.is_blank_row("c").alias("blank_row"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS filled, count(*) FILTER (o_orderstatus = 'F') * 2 > count(*) FILTER (o_orderstatus <> 'P') AS is_text FROM orders GROUP BY 1""")
def text_columns(spark, sf):
    v = F.when(F.col("o_orderstatus") == "F", "open").when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("string")).otherwise(" ")
    return R.text_columns(table(spark, sf, "orders").select("o_custkey", F.lit(0).alias("c"), v.alias("v")), ["o_custkey"], "c", "v").select("o_custkey", "filled", "is_text")


@query("""SELECT p_brand, CASE WHEN bool_or(p_size = 50) THEN 'string' WHEN bool_or(p_retailprice <> floor(p_retailprice)) THEN 'float' ELSE 'int' END AS type FROM part GROUP BY 1""")
def infer_column_types(spark, sf):
    v = F.when(F.col("p_size") == 50, F.col("p_name")).otherwise(F.format_string("%.2f", "p_retailprice"))
    return R.infer_type(table(spark, sf, "part").select("p_brand", v.alias("v")), ["p_brand"], "v")


@query("""SELECT p_partkey, p_brand || '|' || p_size || ' u' AS units, CASE p_partkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'currency' END AS hint FROM part""")
def header_units_and_hints(spark, sf):
    h = F.concat(F.lit("Area ("), F.col("p_size").cast("string"), F.lit(" u), "), "p_brand")
    f = F.when(F.col("p_partkey") % 3 == 0, "dd.mm.yyyy").when(F.col("p_partkey") % 3 == 1, "#,##0.00 €").otherwise("General")
    return table(spark, sf, "part").select("p_partkey", F.array_join(R.header_units(h), "|").alias("units"), R.format_hint(f).alias("hint"))


@query("""SELECT o_custkey, coalesce(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) - min(o_orderkey), count(*)) AS header_rows FROM orders GROUP BY 1""")
def leading_text_rows(spark, sf):
    cells = F.array("o_orderstatus", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).otherwise("none"))
    return R.header_rows_by_type(table(spark, sf, "orders").select("o_custkey", "o_orderkey", cells.alias("c")), "o_custkey", "o_orderkey", "c")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'P') AS n_rows, max(CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 2 END) AS n_cols FROM orders GROUP BY 1""")
def table_sizes(spark, sf):
    cells = F.when(F.col("o_orderstatus") == "F", F.array("o_orderstatus", "o_orderpriority", "o_orderstatus")).otherwise(F.array("o_orderstatus", "o_orderpriority"))
    return R.table_size(table(spark, sf, "orders").select("o_custkey", cells.alias("c"), (F.col("o_orderstatus") == "P").alias("t")), "o_custkey", "c", "t")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 3 AS batch_no FROM lineitem""")
def batch_rows(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return D.batches(rows, ["l_orderkey"], "o", 3).select("l_orderkey", "l_linenumber", "l_partkey", F.col("batch_no").cast("long").alias("batch_no"))


@query("""SELECT o_custkey AS doc, count(*) AS n, list_aggregate(list(o_orderkey ORDER BY o_orderkey), 'string_agg', ',') AS keys FROM orders GROUP BY 1""")
def records_by_page(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.lit(0).alias("page_no"), F.col("o_orderkey").alias("row_idx"), "o_orderstatus")
    return D.records_by_page(rows, "doc").select("doc", F.size("records").cast("long").alias("n"), F.array_join(F.transform("records", lambda r: r["row_idx"].cast("string")), ",").alias("keys"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 20""")
def equality_filter_head(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(20)


# --- grids and titles -----------------------------------------------------------------------


@query("""WITH s AS (SELECT n_nationkey, (n_nationkey // 2)::BIGINT AS k FROM nation), b AS (SELECT n_nationkey, k, r_regionkey * 16 AS column_start FROM s, region
QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY abs(k * 3 - r_regionkey * 16), r_regionkey) = 1) SELECT k, column_start, count(*) OVER (PARTITION BY k) AS n FROM b""")
def nearest_column_equal_spans(spark, sf):
    """Equal spans stay as many rows as they are."""
    k = F.floor(F.col("n_nationkey") / 2)
    s = table(spark, sf, "nation").select(F.lit(1).alias("page"), k.alias("k"), (k * 3).alias("x"))
    c = table(spark, sf, "region").select(F.lit(1).alias("page"), (F.col("r_regionkey") * 16).alias("start"))
    out = G.nearest_column(s, c, ["page"], "x", "start", 4).select("k", "column_start")
    return out.join(out.groupBy("k").agg(F.count("*").alias("n")), "k")


@query("""SELECT l_suppkey % 10 AS col, l_returnflag, min(l_linenumber) AS lo, max(l_linenumber + l_quantity::INT) AS hi FROM lineitem GROUP BY ALL""")
def column_bounds(spark, sf):
    spans = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("col"), "l_returnflag", F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("hi"))
    return G.column_bounds(spans, ["l_returnflag"], "col")


@query("""WITH h AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS r, o_orderstatus AS t FROM orders), g AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY doc ORDER BY r) <= 300 THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY r) AS grp FROM g) SELECT doc, min(r) AS first_row, string_agg(t, ' ' ORDER BY r) AS title FROM k GROUP BY doc, grp""")
def title_groups(spark, sf):
    h = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("r"), F.col("o_orderstatus").alias("t")).distinct()
    return G.title_groups(h, ["doc"], "r", "t", 300)


_BODY = """b AS (SELECT o_custkey AS doc, o_orderkey AS r, CASE WHEN o_orderstatus = 'P' THEN 'table' WHEN o_orderstatus = 'F' THEN 'heading' WHEN o_orderkey % 2 = 0 THEN 'scattered' ELSE 'text' END AS kind, o_orderpriority AS t FROM orders)"""


def _body(spark, sf):
    s = F.col("o_orderstatus")
    kind = F.when(s == "P", "table").when(s == "F", "heading").when(F.col("o_orderkey") % 2 == 0, "scattered").otherwise("text")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("r"), kind.alias("kind"), F.col("o_orderpriority").alias("t"))


@query(f"""WITH {_BODY}, l AS (SELECT *, last_value(CASE WHEN kind <> 'scattered' THEN kind || ':' || t END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b)
SELECT doc, r, CASE WHEN above LIKE 'heading:%' THEN substr(above, 9) END AS label FROM l WHERE kind = 'table'""")
def heading_above_region(spark, sf):
    return G.label_above(_body(spark, sf), ["doc"], "r", "kind", "t").where("kind = 'table'").select("doc", "r", "label")


@query(f"""WITH {_BODY}, l AS (SELECT *, last_value(CASE WHEN kind = 'table' THEN '-' WHEN kind = 'heading' THEN t END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM b WHERE kind IN ('table', 'heading'))
SELECT doc, r, nullif(above, '-') AS title FROM l WHERE kind = 'table'""")
def title_paragraph_lookup(spark, sf):
    body = _body(spark, sf).where("kind in ('table', 'heading')").withColumn("kind", F.when(F.col("kind") == "table", "tbl").otherwise("p"))
    return G.title_paragraph(body, ["doc"], "r", "kind", "t").select("doc", "r", "title")


@query("""WITH x AS (SELECT o_custkey AS doc, o_orderkey AS r, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS v, o_orderkey % 2 = 0 AS is_text FROM orders),
l AS (SELECT *, last_value(CASE WHEN v <> '' THEN r END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY r) AS at FROM x)
SELECT l.doc, l.r, CASE WHEN s.is_text AND NOT l.is_text THEN '' ELSE coalesce(s.v, '') END AS filled FROM l LEFT JOIN x s ON l.doc = s.doc AND l.at = s.r""")
def fill_within_kind(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("r"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("v"), (F.col("o_orderkey") % 2 == 0).alias("is_text"))
    return G.fill_within_kind(x, ["doc"], "r", "v", "is_text", "filled").select("doc", "r", "filled")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey WHEN n_nationkey % 3 = n_regionkey THEN n_regionkey WHEN n_nationkey % 3 = 2 THEN 2 ELSE n_regionkey END AS header_rows FROM nation""")
def cross_validated_headers(spark, sf):
    v, t = F.col("n_nationkey") % 3, F.col("n_regionkey")
    return table(spark, sf, "nation").select("n_nationkey", L.header_verdict(v, t, F.lit(2)).alias("header_rows"))


@query("""WITH c AS (SELECT o_custkey AS doc, o_orderkey AS r FROM orders), n AS (SELECT doc, r, row_number() OVER (PARTITION BY doc ORDER BY r) - 1 AS i FROM c)
SELECT doc, CASE WHEN i < 1 THEN i ELSE 1 + (i - 1) // 2 END::INT AS "row", string_agg(r::VARCHAR, ' ' ORDER BY i) AS text FROM n GROUP BY ALL""")
def merge_multi_row_records(spark, sf):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    spans = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), i.alias("row"), F.lit(0).alias("col"), F.col("o_orderkey").cast("string").alias("text"))
    periods = spans.select("doc").distinct().select("doc", F.lit(1).alias("header"), F.lit(2).alias("period"))
    return L.merge_periods(spans, periods, ["doc"]).select("doc", "row", "text")


@query("""SELECT n_regionkey AS doc, 0 AS "left", 1 AS "right" FROM nation GROUP BY 1""")
def twin_columns(spark, sf):
    """Column 0 is filled in even rows, column 1 in odd ones, column 2 in all."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("row"))
    cells = n.select("doc", "row", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("col_idx"))
    cells = cells.withColumn("text", F.when((F.col("col_idx") == 2) | (F.col("row") % 2 == F.col("col_idx")), "x").otherwise(""))
    return L.twin_columns(cells, ["doc"])


# --- geography and suggestions --------------------------------------------------------------


def _features(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("geoname_id"), F.initcap("n_name").alias("name"), F.lower("n_name").alias("asciiname"), (F.col("n_nationkey") * 1.5).alias("lat"), (F.col("n_nationkey") * -2.5).alias("lng"),
                    F.lit("A").alias("feature_class"), F.when(F.col("n_nationkey") % 2 == 0, "ADM1").otherwise("ADM2").alias("feature_code"), F.concat(F.lit("R"), "n_regionkey").alias("country_code"), F.lit("01").alias("admin1_code"), (F.col("n_nationkey") * 1000).cast("long").alias("population"))


@query("""SELECT n_nationkey::BIGINT AS geoname_id, 'R' || n_regionkey AS country_code FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0""")
def enumerate_features(spark, sf):
    return O.enumerate_features(_features(spark, sf), "R2", "ADM1").select("geoname_id", "country_code")


@query("""SELECT n_nationkey::BIGINT AS geoname_id, n_nationkey * 1.5::DOUBLE AS lat, n_nationkey * -2.5::DOUBLE AS lng, '01' AS admin1_code, (n_nationkey * 1000)::BIGINT AS population FROM nation WHERE n_nationkey < 10""")
def enrich_features(spark, sf):
    uris = table(spark, sf, "nation").where("n_nationkey < 10").select(F.concat(F.lit("https://x.org/"), "n_nationkey", F.lit("/")).alias("uri"))
    return O.enrich_features(uris, _features(spark, sf)).select("geoname_id", "lat", "lng", "admin1_code", "population")


@query("""SELECT n_nationkey::BIGINT AS geoname_id, n_nationkey * 1000::BIGINT AS population FROM nation WHERE contains(lower(n_name), 'a') ORDER BY population DESC, geoname_id LIMIT 5""")
def search_gazetteer(spark, sf):
    return O.search_features(_features(spark, sf), "A", limit=5).select("geoname_id", "population")


@query("""SELECT unnest(['p_brand', 'p_type']) AS "column", unnest([(SELECT count(DISTINCT p_brand) FROM part), (SELECT count(DISTINCT p_type) FROM part)]) AS distinct_values, unnest([(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT p_brand AS v FROM part ORDER BY 1 LIMIT 10)), (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY 1 LIMIT 10))]) AS samples""")
def column_samples(spark, sf):
    return O.samples(table(spark, sf, "part"), ["p_brand", "p_type"]).select("column", "distinct_values", F.array_join("samples", "|").alias("samples"))


@query()
def fuzzy_suggestions(spark, sf):
    """The five best labels over 50 for misspelt nation names."""
    n = table(spark, sf, "nation")
    asked = n.select("n_nationkey", F.concat(F.lower(F.substring("n_name", 1, 3)), F.lower(F.substring("n_name", 5, 20))).alias("asked"))
    labels = [r["n_name"] for r in n.orderBy("n_nationkey").collect()]  # a vocabulary's labels
    return asked.select("n_nationkey", F.explode(suggestions(F.col("asked"), labels)).alias("s")).select("n_nationkey", "s.label", "s.score")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def incremental_latest(spark, sf):
    """The latest order of each customer, kept over three batches that come one after the other."""
    from .streaming.events import merge_latest

    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    state = None
    for k in range(3):
        state = merge_latest(state, o.where(F.col("o_orderkey") % 3 == k), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return state


@query("""SELECT n_nationkey, lower(n_name) || '  x' AS raw, 'number' AS kind, 100.0::DOUBLE AS score FROM nation""")
def sql_functions(spark, sf):
    """Functions registered for SQL."""
    from .sql import register

    register(spark)
    table(spark, sf, "nation").createOrReplaceTempView("tb_nation")
    return spark.sql("SELECT n_nationkey, lower(n_name) || '  x' AS raw, cell_type(cast(n_nationkey AS string) || '.5') AS kind, fuzz_ratio(n_name, n_name) AS score FROM tb_nation WHERE normalize_pipe_table(lower(n_name) || '  x') = lower(n_name) || ' x'")
