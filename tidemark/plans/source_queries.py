"""Registered queries for scans, sinks, dataset contracts and pages, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import maintenance
from ..sources import pages, tables
from ..streaming.twins import shared_root
from .contests import load
from .queries import query

# files: written to the shared folder first, then read back


@query("SELECT c_custkey, c_name, c_acctbal, CAST(NULL AS INTEGER) AS absent FROM customer")
def csv_typed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A sink with a fixed column order and an absent column; a scan that infers types."""
    path = f"{shared_root(spark, 'csv')}/customers"
    tables.write_csv(load(spark, d, "customer").select("c_acctbal", "c_custkey", "c_name", "c_mktsegment"), path, ["c_custkey", "c_name", "c_acctbal", "absent"])
    return tables.csv(spark, path).select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_acctbal").cast("double"), F.col("absent").cast("int"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN '007' ELSE 'a "b",' || chr(10) || 'c' END AS odd, '' AS lacking FROM part""")
def csv_text_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All columns as text, byte for byte: quotes, line ends, NA and leading zeros survive; a lacking column is ''."""
    k = F.col("p_partkey")
    odd = F.when(k % 4 == 0, "").when(k % 4 == 1, "NA").when(k % 4 == 2, "007").otherwise('a "b",\nc')
    path = f"{shared_root(spark, 'csv')}/parts"
    tables.write_csv(load(spark, d, "part").select(k.cast("string").alias("p_partkey"), odd.alias("odd")), path, ["p_partkey", "odd"])
    return tables.string_csv(spark, path, ["p_partkey", "odd", "lacking"])


@query("SELECT 'missing' AS file, CAST(0 AS BIGINT) AS rows, 'a,b' AS columns UNION ALL SELECT 'there', count(*), 'p_partkey,p_name,lacking' FROM part")
def csv_missing_file(spark: SparkSession, d: str) -> DataFrame:
    """A file that isn't there is an empty table with the stated columns; one that is there has its rows, with those that it lacks as nulls."""
    root = shared_root(spark, "csv")
    tables.write_csv(load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), "p_name"), f"{root}/parts", ["p_partkey", "p_name"])
    found = {"missing": tables.string_csv(spark, f"{root}/none", ["a", "b"]), "there": tables.string_csv(spark, f"{root}/parts", ["p_partkey", "p_name", "lacking"])}
    one = lambda n, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("file"), "rows", F.lit(",".join(df.columns)).alias("columns"))
    return one("missing", found["missing"]).unionByName(one("there", found["there"]))


_BUNDLE = ("customer", "supplier", "nation")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _BUNDLE))
def bundle_load(spark: SparkSession, d: str) -> DataFrame:
    """All tables of a bundle by name."""
    counts = [load(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows") for t in _BUNDLE]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9))")
def scan_by_parent(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the contests that touch the wanted entities; the condition is pushed to the parents' scan."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = load(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return tables.semi_scan(lines, orders, "l_orderkey", F.col("o_custkey").isin(1, 5, 9))


@query("""SELECT o_orderkey AS contest_id, CAST(o_orderdate AS DATE) AS event_day, CAST(o_orderkey % 2 AS INTEGER) AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE o_orderpriority END AS grp
    FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 9 <> 0""")
def training_scan(spark: SparkSession, d: str) -> DataFrame:
    """Dated, labelled rows; labels are whole numbers; missing categories are Unknown."""
    k = F.col("o_orderkey")
    label = F.when(k % 7 == 0, "n/a").otherwise((k % 2).cast("string"))
    day = F.when(k % 9 == 0, "not a day").otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10))
    rows = load(spark, d, "orders").select(k.alias("contest_id"), day.alias("event_day"), label.alias("label"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("grp"))
    return tables.training_rows(rows, categories=["grp"])


@query("SELECT c_custkey, c_name, 'c_phone,c_age' AS lacking FROM customer")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """The wanted columns that there are, and the names of the others."""
    df, lacking = tables.pruned(load(spark, d, "customer"), ["c_custkey", "c_phone", "c_name", "c_age"])
    return df.withColumn("lacking", F.lit(",".join(lacking)))


@query("SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS day, 'none' AS grp FROM orders WHERE o_orderkey % 9 <> 0")
def detected_schema(spark: SparkSession, d: str) -> DataFrame:
    """Columns by candidate names, exactly or in another case; undated rows are dropped."""
    o = load(spark, d, "orders").withColumn("O_Day", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date"))).drop("o_orderdate")
    entity, day, group = (tables.resolve_column(o, c) for c in (["entity_id", "O_CUSTKEY"], ["event_day", "o_day"], ["grp", "division"]))
    return o.select(F.col(entity).alias("entity"), F.col(day).alias("day"), F.lit(group or "none").alias("grp")).filter("day is not null")


@query("SELECT '' AS c_age, c_name, '' AS c_phone FROM customer")
def aligned_columns(spark: SparkSession, d: str) -> DataFrame:
    """Exactly the stated columns; missing ones are ''."""
    return tables.align(load(spark, d, "customer"), ["c_age", "c_name", "c_phone"], fill="")


# contracts


@query("""SELECT 'orders' AS name, count(*) AS rows, max(CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 11 <> 0 AND CAST(o_orderdate AS DATE) <= DATE '1997-01-01') AS last_day,
    count(*) FILTER (o_orderkey % 11 = 0 OR CAST(o_orderdate AS DATE) > DATE '1997-01-01') AS bad_dates FROM orders""")
def table_facts_planted(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a table with malformed and future dates."""
    day = F.when(F.col("o_orderkey") % 11 == 0, "1996-13-45").otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10))
    return tables.table_facts(load(spark, d, "orders").withColumn("day", day), "orders", "day", F.lit("1997-01-01").cast("date")).drop("columns")


@query("SELECT 'customer' AS name, 'ok' AS status, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'nation', 'columns', (SELECT count(*) FROM nation) UNION ALL SELECT 'orders', 'dates', (SELECT count(*) FROM orders) UNION ALL SELECT 'empty', 'empty', 0 UNION ALL SELECT 'none', 'missing', NULL")
def dataset_contract(spark: SparkSession, d: str) -> DataFrame:
    """What a manifest asks for against the facts of the tables."""
    o = load(spark, d, "orders").withColumn("day", F.lit("oops"))
    facts = tables.table_facts(load(spark, d, "customer"), "customer").unionByName(tables.table_facts(load(spark, d, "nation"), "nation"))
    facts = facts.unionByName(tables.table_facts(o, "orders", "day")).unionByName(tables.table_facts(o.limit(0), "empty"))
    asked = [("customer", ["c_custkey"]), ("nation", ["n_nationkey", "n_flag"]), ("orders", ["o_orderkey"]), ("empty", ["o_orderkey"]), ("none", ["x"])]
    return tables.contract_status(facts, spark.createDataFrame(asked, "name string, required array<string>")).join(facts.select("name", "rows"), "name", "left")


@query("SELECT CAST(octet_length(encode(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10))) AS BIGINT) AS bytes, sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS sha256 FROM nation")
def dataset_state(spark: SparkSession, d: str) -> DataFrame:
    """Size and hash of every file, where it lies."""
    path = f"{shared_root(spark, 'state')}/nations"
    load(spark, d, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(path)
    return tables.file_hashes(spark, path).filter(~F.col("path").rlike(r"/[._][^/]*$")).select("bytes", "sha256")


@query("SELECT r_regionkey, r_name FROM region")
def staged_install(spark: SparkSession, d: str) -> DataFrame:
    """A staged table, checked before it is moved into place; a refused one leaves nothing there, and nothing is overwritten."""
    from ..operators.contracts import ContractError, duplicate_keys, require

    root, region = shared_root(spark, "install"), load(spark, d, "region").select("r_regionkey", "r_name")
    check = lambda df: require(duplicate_keys(df, ["r_regionkey"]), "keys repeat")
    try:
        tables.publish(region.unionByName(region), root, "region", [check])
    except ContractError:
        return tables.publish(region, root, "region", [check])
    raise AssertionError("repeated keys were not refused")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines that hold no NaN; a table with one is refused before anything is written."""
    from ..operators.contracts import ContractError

    path, s = f"{shared_root(spark, 'json')}/suppliers", load(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    try:
        maintenance.write_json(s.withColumn("s_acctbal", F.when(F.col("s_suppkey") == 1, float("nan")).otherwise(F.col("s_acctbal"))), path)
    except ContractError:
        maintenance.write_json(s, path)
    return spark.read.schema(s.schema).json(path)


# pages: orders as HTML, read back


def order_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, html): each order as a page with a nested layout table, an event row, a table of its lines and a list of labels."""
    cell = lambda *parts: F.concat(F.lit("<td>"), *[F.concat(F.lit("<p>"), x, F.lit("</p>")) for x in parts], F.lit("</td>"))
    key, qty = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    tried = (F.col("l_quantity").cast("int") + 5).cast("string")
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lit("part "), key), F.concat(F.lit(" supplier\n"), F.col("l_suppkey").cast("string"))), cell(F.concat(qty, F.lit(" of "), tried), F.lit("---")), F.lit("</tr>"))
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    o = load(spark, d, "orders").join(lines, "o_orderkey")
    k = F.col("o_orderkey")
    event = F.concat(F.lit('<table class="x"><tr><th>Event</th></tr><tr><td><a href="/e/'), (F.floor(k / 4)).cast("string"), F.lit('"> Event <b>'), F.floor(k / 4).cast("string"), F.lit("</b>\n</a></td><td>"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</td></tr></table>"))
    stats = F.concat(F.lit("<table><tr><th> Who</th><th>HITS </th></tr>"), F.col("rows"), F.lit("</table>"))
    born = F.date_format("o_orderdate", "MMM d, yyyy")
    profile = F.concat(F.lit("<ul><li><i>Height:</i> "), (5 + k % 2).cast("string"), F.lit("' "), (k % 12).cast("string"), F.lit('"</li><li>Reach: '), F.when(k % 5 == 0, "--").otherwise(F.concat((60 + k % 20).cast("string"), F.lit('"'))), F.lit("</li><li>STANCE: "), F.when(k % 3 == 0, "").otherwise("Open"), F.lit("</li><li>DOB: "), F.when(k % 4 == 0, "--").otherwise(born), F.lit("</li></ul>"))
    return o.select(k.alias("page_id"), F.concat(F.lit("<html><script>var t='<table>';</script>"), event, stats, profile, F.lit("</html>")).alias("html"))


@query("""SELECT '/e/' || CAST(o_orderkey // 4 AS VARCHAR) AS url, 'Event ' || CAST(o_orderkey // 4 AS VARCHAR) AS name, CAST(arg_min(o_orderdate, o_orderkey) AS DATE) AS day
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey // 4""")
def page_events(spark: SparkSession, d: str) -> DataFrame:
    """Listed events with a date, each URL once."""
    return pages.listed_events(order_pages(spark, d))


_SIDES = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""


@query(f"""WITH {_SIDES} SELECT l_orderkey AS page_id, CAST(rn AS INTEGER) AS row, 'part ' || l_partkey || ' | supplier ' || l_suppkey AS who, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' of ' || CAST(CAST(l_quantity AS INTEGER) + 5 AS VARCHAR) || ' | ---' AS hits FROM li""")
def page_contests(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the first table whose header has the wanted names, as named fields."""
    rows = pages.first_tables(order_pages(spark, d), ["hits", "Who"])
    return pages.listed_contests(rows, ["who", "hits"]).drop("table")


@query(f"""WITH {_SIDES} SELECT l_orderkey AS page_id, CAST(rn AS INTEGER) AS row, s AS side, CASE s WHEN 0 THEN 'part ' || l_partkey ELSE 'supplier ' || l_suppkey END AS name,
    CASE s WHEN 0 THEN CAST(l_quantity AS BIGINT) END AS hits_made, CASE s WHEN 0 THEN CAST(l_quantity AS BIGINT) + 5 END AS hits_tried FROM li, (VALUES (0), (1)) t(s)""")
def page_sides(spark: SparkSession, d: str) -> DataFrame:
    """One row for each side of paired cells, counts decoded."""
    rows = pages.first_tables(order_pages(spark, d), ["who", "hits"])
    return pages.stat_sides(pages.listed_contests(rows, ["who", "hits"]), "who", ["hits"], ["page_id", "row"])


@query("""SELECT o_orderkey AS page_id, round(CAST((5 + o_orderkey % 2) * 12 + o_orderkey % 12 AS DOUBLE) * 2.54, 2) AS height_cm, CASE WHEN o_orderkey % 5 <> 0 THEN round(CAST(60 + o_orderkey % 20 AS DOUBLE) * 2.54, 2) END AS reach_cm,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Open' END AS stance, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS born FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def page_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Labelled list items as typed fields."""
    return pages.profiles(order_pages(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS method, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_clerk_like END AS details FROM (SELECT *, 'clerk ' || o_custkey AS o_clerk_like FROM orders)""")
def result_box(spark: SparkSession, d: str) -> DataFrame:
    """S24: 'label: value' lines as fields; of repeated labels the last counts."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Details: clerk "), F.col("o_custkey").cast("string"), F.lit("\r\nno label here\n"), F.when(k % 2 == 0, F.concat(F.lit(" METHOD :  "), "o_orderstatus", F.lit("\n"))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("details:"), "o_orderpriority")).otherwise(""))
    found = load(spark, d, "orders").select("o_orderkey", pages.labelled(text).alias("f"))
    return found.select("o_orderkey", F.try_element_at("f", F.lit("method")).alias("method"), F.try_element_at("f", F.lit("details")).alias("details"))


STATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("saved", T.StringType())])


@query("""SELECT 'f' || o_orderkey AS path, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'kept' ELSE o_orderpriority END AS saved FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 4 = 0""")
def saved_results_index(spark: SparkSession, d: str) -> DataFrame:
    """Entries of unchanged files are kept, others are read anew, corrupt files have none."""
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, '{"id": broken').otherwise(F.to_json(F.struct(k.alias("id"), F.col("o_orderpriority").alias("saved"))))
    files = load(spark, d, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), text.alias("content"), k.alias("k"))
    kept = files.filter("k % 4 = 0").select("path", F.sha2("content", 256).alias("sha256"), F.col("k").alias("id"), F.lit("kept").alias("saved"))
    known = kept.unionByName(kept.limit(5).withColumn("path", F.concat("path", F.lit("-gone")))).unionByName(files.filter("k % 4 = 1").select("path", F.lit("old").alias("sha256"), F.lit(-1).cast("bigint").alias("id"), F.lit("stale").alias("saved")))
    return maintenance.result_index(known, files.select("path", "content"), STATE.simpleString()[7:-1].replace(":", " ")).drop("sha256")


@query("""WITH b AS (SELECT p_name || p_partkey AS path, sha256(p_type) AS h FROM part WHERE p_partkey % 5 <> 0), a AS (SELECT p_name || p_partkey AS path, sha256(CASE WHEN p_partkey % 3 = 0 THEN p_type || '!' ELSE p_type END) AS h FROM part WHERE p_partkey % 7 <> 0)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.path = b.path""")
def file_change_map(spark: SparkSession, d: str) -> DataFrame:
    """What became of each path between two listings."""
    p = load(spark, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), "p_partkey", "p_type")
    before = p.filter("p_partkey % 5 <> 0").select("path", F.sha2("p_type", 256).alias("sha256"))
    after = p.filter("p_partkey % 7 <> 0").select("path", F.sha2(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("!"))).otherwise(F.col("p_type")), 256).alias("sha256"))
    return maintenance.change_map(before, after)
