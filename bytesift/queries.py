"""Queries that run each kernel over the parquet tables, each beside SQL that an independent engine can check it with.

The tables hold no disk image; they serve as inputs of the same shape: texts as bytes, prefix sums of
n_chars as a layout of blocks, events of a user as intervals, numbers as flags and offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytesift.functions import columns as C
from bytesift.functions.rules import LANGUAGES, LEAST, REASONS, STRONG, WEAK
from bytesift.operators import aggregates, intervals, names, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(column: str):
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


# --- scalars -------------------------------------------------------------------------------------


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def filetime_iso(spark, sf):
    """Event times as ticks since 1601 and back to text."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", C.filetime_iso((seconds + C.EPOCH) * C.TICKS).alias("iso"))


_REASON = "((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 65536)"
_NAMES = ", ".join(f"CASE WHEN (r & {bit}) <> 0 THEN '{name}' END" for bit, name in REASONS)


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN len(n) = 0 THEN '0x' || lpad(lower(to_hex(r)), 8, '0') ELSE array_to_string(n, '|') END AS reason
FROM (SELECT *, list_filter([{_NAMES}], lambda x: x IS NOT NULL) AS n FROM (SELECT l_orderkey, l_linenumber, ({_REASON} + CASE WHEN l_tax > 0.04 THEN 2147483648 ELSE 0 END)::BIGINT AS r FROM lineitem))""")
def reason_names(spark, sf):
    """Flags made of a line's numbers, decoded to names."""
    r = F.expr(f"{_REASON} + CASE WHEN l_tax > 0.04 THEN 2147483648L ELSE 0L END").cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.reason_names(r).alias("reason"))


@query(r"""
SELECT page_id, CASE WHEN coalesce(len(s), 0) = 0 THEN 'unnamed' ELSE array_to_string(s, '/') END AS path FROM (
  SELECT page_id, list_transform(list_filter(list_transform(string_split(regexp_replace(replace(u, '\', '/'), '^[A-Za-z]:', ''), '/'), lambda x: trim(trim(x, ' ' || chr(9) || chr(10)), '.')), lambda x: x <> ''),
    lambda x: substr(regexp_replace(x, '[<>:"|?*\x00-\x1f]', '_', 'g'), 1, 200)) AS s
  FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'C:' || replace(url, '/', chr(9) || '\ .') END AS u FROM pages))""")
def sanitized_paths(spark, sf):
    """Page addresses as safe relative paths; some with drive letters, tabs and backslashes, some null."""
    odd = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("C:"), F.replace(F.col("url"), F.lit("/"), F.lit("\t\\ ."))))
    return table(spark, sf, "pages").select("page_id", C.sanitized_path(odd).alias("path"))


_OWN = "c_mktsegment || '/n' || (c_custkey // 7) || CASE WHEN c_custkey % 7 = 3 THEN '__' || (c_custkey % 4) ELSE '' END || '.txt'"


@query(f"""
WITH p AS (SELECT c_custkey, {_OWN} AS p FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY c_custkey) - 1 AS i, regexp_extract(p, '[^/.](\\.[^./]*)$', 1) AS x FROM p),
s AS (SELECT *, left(p, length(p) - length(x)) AS root FROM r),
free AS (SELECT p, root, x, n, row_number() OVER (PARTITION BY p ORDER BY n) AS i FROM (SELECT DISTINCT p, root, x FROM s WHERE i > 0) CROSS JOIN range(1, 100) t(n) WHERE root || '__' || n || x NOT IN (SELECT p FROM p))
SELECT c_custkey, CASE WHEN s.i = 0 THEN s.p ELSE s.root || '__' || free.n || s.x END AS unique_path FROM s LEFT JOIN free ON s.p = free.p AND s.i = free.i""")
def unique_names(spark, sf):
    """Colliding paths get numbered; some paths look numbered already, so the first numbers aren't always free."""
    rows = table(spark, sf, "customer").select("c_custkey", F.expr(_OWN.replace("c_custkey // 7", "c_custkey div 7")).alias("p"))
    return names.unique_names(rows, "p", ["c_custkey"], zone=F.floor(F.col("c_custkey") / 100)).select("c_custkey", "unique_path")


@query("""SELECT o_orderkey, '0x' || lower(to_hex(o_orderkey * 4096)) AS offset_hex, lpad(lower(to_hex(o_orderkey * 4096)), 12, '0') AS padded FROM orders""")
def hex_offsets(spark, sf):
    at = F.col("o_orderkey") * 4096
    return table(spark, sf, "orders").select("o_orderkey", C.hex_offset(at).alias("offset_hex"), F.lpad(F.lower(F.hex(at)), 12, "0").alias("padded"))


@query("""SELECT doc_id, replace(substr(coalesce(text, ''), 1, 60), chr(10), ' ') AS preview, substr(coalesce(text, ''), 1, 65536) AS head FROM documents""")
def previews(spark, sf):
    """The manifest's short preview and the viewer's long one."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", C.preview(t).alias("preview"), F.substring(t, 1, 65536).alias("head"))


@query("""
SELECT o_orderkey, CASE WHEN abs(n) < 1024 THEN printf('%.1f B', n) WHEN abs(n) < 1048576 THEN printf('%.1f KiB', n / 1024) WHEN abs(n) < 1073741824 THEN printf('%.1f MiB', n / 1048576)
  WHEN abs(n) < 1099511627776 THEN printf('%.1f GiB', n / 1073741824) ELSE printf('%.1f TiB', n / 1099511627776) END AS size
FROM (SELECT o_orderkey, (o_orderkey % 1000 + 1) * power(2, o_orderkey % 5 * 10)::DOUBLE * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS n FROM orders)""")
def human_sizes(spark, sf):
    n = (F.col("o_orderkey") % 1000 + 1) * F.pow(F.lit(2.0), F.col("o_orderkey") % 5 * 10) * F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    return table(spark, sf, "orders").select("o_orderkey", C.human_size(n).alias("size"))


@query("""
SELECT o_orderkey, CASE WHEN resident THEN 'resident' WHEN runs > 0 THEN 'non-resident' WHEN size = 0 THEN 'empty' ELSE 'none' END AS storage,
  CASE WHEN resident THEN 'yes' WHEN runs > 0 THEN 'partial' ELSE 'no' END AS recovered
FROM (SELECT o_orderkey, o_orderstatus = 'F' AS resident, o_orderkey % 3 AS runs, o_custkey % 2 AS size FROM orders)""")
def storage_labels(spark, sf):
    resident, runs = F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3
    return table(spark, sf, "orders").select("o_orderkey", C.storage_label(resident, runs, F.col("o_custkey") % 2).alias("storage"), F.when(resident, "yes").when(runs > 0, "partial").otherwise("no").alias("recovered"))


# --- filters -------------------------------------------------------------------------------------


@query("""SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '^(c|p)') AND (event_id & 512) <> 0""")
def manifest_predicates(spark, sf):
    """A status by its beginning, and a flag by its bit."""
    return table(spark, sf, "events").where(F.rlike("event_type", F.lit("^(c|p)")) & (F.col("event_id").bitwiseAND(512) != 0)).select("event_id", "event_type")


@query("""SELECT page_id, url FROM pages WHERE contains(lower(list_last(string_split(url, '/'))), '1')""")
def name_filter(spark, sf):
    """Part of the last segment, whatever its case."""
    return table(spark, sf, "pages").where(C.name_contains(F.col("url"), "1")).select("page_id", "url")


@query("""SELECT DISTINCT source FROM documents WHERE contains(text, 'License')""")
def content_grep(spark, sf):
    return table(spark, sf, "documents").where(F.contains("text", F.lit("License"))).select("source").distinct()


@query("""SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND length(p_name) > 0 AND p_type NOT LIKE 'STANDARD%'""")
def size_bounds(spark, sf):
    """Bounds of a size, no empty name, no directory-like kind: all pushed to the scan."""
    return table(spark, sf, "part").where(F.col("p_size").between(10, 20) & (F.length("p_name") > 0) & ~F.col("p_type").startswith("STANDARD")).select("p_partkey", "p_size")


@query("""SELECT doc_id, strpos(coalesce(text, ''), 'the')::INT - 1 AS at FROM documents""")
def first_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.locate("the", F.coalesce("text", F.lit(""))) - 1).alias("at"))


_BLOCK = "SELECT o_orderkey, repeat(CASE o_orderkey % 4 WHEN 0 THEN '00' WHEN 1 THEN 'FF' ELSE lpad(to_hex(o_custkey % 256), 2, '0') END, 64) || repeat('41', (o_orderkey % 20)::INT) AS h FROM orders"


@query(f"""
SELECT o_orderkey, CASE WHEN f = n AND o_orderkey % 20 = 0 AND n > 0 THEN 'ff' WHEN z >= n - 16 THEN 'zero' END AS dead, n - z <= 16 AS nearly_zero
FROM (SELECT o_orderkey, len(b) AS n, len(list_filter(b, lambda x: x = '00')) AS z, len(list_filter(b, lambda x: x = 'FF')) AS f FROM (SELECT o_orderkey, regexp_extract_all(h, '..') AS b FROM ({_BLOCK})))""")
def block_liveness(spark, sf):
    """Blocks that are all zero but 16 bytes, or full and all 0xFF."""
    byte = "CASE o_orderkey % 4 WHEN 0 THEN '00' WHEN 1 THEN 'FF' ELSE lpad(hex(o_custkey % 256), 2, '0') END"
    data = F.unhex(F.concat(F.expr(f"repeat({byte}, 64)"), F.expr("repeat('41', cast(o_orderkey % 20 AS INT))")))
    rows = table(spark, sf, "orders").select("o_orderkey", data.alias("d"))
    return rows.select("o_orderkey", C.is_dead(F.col("d"), F.col("o_orderkey") % 20 == 0).alias("dead"), (F.octet_length("d") - C.byte_count(F.col("d"), 0) <= 16).alias("nearly_zero"))


# --- aggregates ----------------------------------------------------------------------------------


@query("""SELECT source AS kind, lang AS ext, count(*) AS n FROM documents GROUP BY ALL""")
def kind_counts(spark, sf):
    return aggregates.class_counts(table(spark, sf, "documents").select(F.col("source").alias("kind"), F.col("lang").alias("ext")), ["kind", "ext"])


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def class_counts(spark, sf):
    return aggregates.class_counts(table(spark, sf, "events"), ["event_type"])


@query("""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(substr(hex(encode(coalesce(html, ''))), 1, 8192), '..')) AS x FROM pages), c AS (SELECT page_id, x, count(*) AS n FROM b GROUP BY ALL)
SELECT page_id, coalesce(e, 0) AS entropy FROM pages LEFT JOIN (SELECT page_id, round(greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS e FROM c GROUP BY page_id) USING (page_id)""")
def byte_entropy(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", _bytes("html").alias("d"))
    return aggregates.byte_entropy(rows, "page_id", "d").select("page_id", F.round("entropy", 6).alias("entropy"))


@query("""SELECT count(*) AS listed, count(*) FILTER (o_orderstatus = 'F') AS resident, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS targeted, count(*) FILTER (o_orderpriority LIKE '%URGENT%') AS wiped FROM orders""")
def record_counters(spark, sf):
    m = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "resident").when(F.col("o_orderstatus") == "O", "non-resident").alias("storage"),
        F.when(F.col("o_orderpriority").startswith("1"), "yes").otherwise("no").alias("recovered"),
        F.when(F.col("o_orderpriority").contains("URGENT"), "TRIMed").otherwise("").alias("note"),
    )
    return aggregates.record_counters(m)


@query("""SELECT count(*) AS events, count(*) FILTER (contains(event_type, 'c')) AS deletes FROM events""")
def journal_counters(spark, sf):
    return aggregates.journal_counters(table(spark, sf, "events").select(F.when(F.contains("event_type", F.lit("c")), "FILE_DELETE|CLOSE").otherwise("CLOSE").alias("reason")))


@query("""
SELECT 'resident' AS card, count(*) FILTER (regexp_matches(o_orderstatus, '^(F|P)')) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'files', count(*) FROM pages UNION ALL SELECT 'fragments', count(*) FROM documents""")
def result_cards(spark, sf):
    t = lambda n: table(spark, sf, n)
    every = F.lit(True)
    return aggregates.result_cards({"resident": (t("orders"), F.rlike("o_orderstatus", F.lit("^(F|P)"))), "events": (t("events"), every), "files": (t("pages"), every), "fragments": (t("documents"), every)})


@query("""SELECT l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, l_quantity * 100000000.0 - (l_orderkey * 10 + l_linenumber)) AS line, max(l_quantity)::BIGINT AS points FROM lineitem GROUP BY l_suppkey""")
def best_rules(spark, sf):
    """The highest score in each group, ties to the lowest rank."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_suppkey", line.alias("line"), line.alias("rank"), F.col("l_quantity").cast("long").alias("points"))
    return aggregates.best_by(rows, ["l_suppkey"], "points", "rank", "line")


@query("""
SELECT n_regionkey, arg_min(n_name, CASE WHEN n_nationkey % 3 = 2 THEN 1000000 ELSE 0 END + CASE WHEN n_nationkey % 3 = 2 THEN 0 ELSE -length(n_name) * 1000 END + n_nationkey) AS name FROM nation GROUP BY n_regionkey""")
def picked_names(spark, sf):
    """The longest name outside one space, else the first."""
    per = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    listed = F.transform("l", lambda x: F.struct((x["n_nationkey"] % 3).alias("ns"), x["n_name"].alias("name"), x["n_nationkey"].alias("parent")))
    return per.select("n_regionkey", names.picked_name(listed)["name"].alias("name"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents""")
def digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(_bytes("text"), 256).alias("digest"))


@query("""SELECT round(100.0 * (count(*) FILTER (l_returnflag = 'R') + count(*) FILTER (l_returnflag = 'A')) / greatest(1, count(*)), 6) AS dead FROM lineitem""")
def dead_percentage(spark, sf):
    n = table(spark, sf, "lineitem").agg(F.count_if(F.col("l_returnflag") == "R").alias("zero"), F.count_if(F.col("l_returnflag") == "A").alias("ff"), F.count("*").alias("blocks"))
    return n.select(F.round(aggregates.dead_percent(F.col("zero"), F.col("ff"), F.col("blocks")), 6).alias("dead"))


@query("""SELECT DISTINCT l_partkey * 512 AS part_offset FROM lineitem""")
def distinct_offsets(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_partkey") * 512).alias("part_offset")).distinct()


# --- intervals -----------------------------------------------------------------------------------

_LAYOUT = "SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM documents"


def _layout(spark, sf):
    """Documents laid end to end: offsets by two sums, of zones of ids and inside them."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 4096).alias("z"))
    zones = docs.groupBy("z").agg(F.sum("n_chars").alias("n"))
    before = zones.select("z", F.coalesce(F.sum("n").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    inside = F.coalesce(F.sum("n_chars").over(Window.partitionBy("z").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.withColumn("i", inside).join(before, "z").select("doc_id", "n_chars", (F.col("i") + F.col("b")).alias("s"))


@query(f"""
WITH l AS (SELECT 'all' AS image, s, s + n_chars AS e FROM ({_LAYOUT}) WHERE doc_id % 3 = 0),
f AS (SELECT *, CASE WHEN s - max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2000 THEN 0 ELSE 1 END AS b FROM l),
g AS (SELECT *, sum(b) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT image, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY image, k""")
def gap_merge(spark, sf):
    """Every third document's place, united over gaps of at most 2000."""
    live = _layout(spark, sf).where("doc_id % 3 = 0").select(F.lit("all").alias("image"), "s", (F.col("s") + F.col("n_chars")).alias("e"))
    return intervals.merge_gaps(live, ["image"], "s", "e", 2000, zone=1 << 20)


@query(f"""SELECT count(*) AS extents, sum(n_chars)::BIGINT AS bytes FROM ({_LAYOUT}) WHERE doc_id % 3 = 0""")
def extent_totals(spark, sf):
    live = _layout(spark, sf).where("doc_id % 3 = 0").select("s", (F.col("s") + F.col("n_chars")).alias("e"))
    return intervals.totals(live, "s", "e")


@query("""SELECT l_orderkey, l_linenumber, sum(l_partkey - l_suppkey * 20) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS lcn FROM lineitem""")
def running_lcn(spark, sf):
    """Cluster numbers from signed steps."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_partkey") - F.col("l_suppkey") * 20).over(w).alias("lcn"))


_USER = "SELECT user_id, event_id, epoch_ms(ts)::BIGINT AS s, epoch_ms(ts)::BIGINT + 3600000 * (1 + event_id % 5) AS e, event_type <> 'click' AS ok FROM events"


def _user(spark, sf):
    s = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("user_id", "event_id", s.alias("s"), (s + F.lit(3_600_000) * (1 + F.col("event_id") % 5)).alias("e"), (F.col("event_type") != "click").alias("ok"))


@query(f"""
WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM ({_USER})),
g AS (SELECT user_id, k, event_id, e AS mark, true AS took FROM u WHERE k = 1 UNION ALL
  SELECT u.user_id, u.k, u.event_id, CASE WHEN u.s >= g.mark THEN u.e ELSE g.mark END, u.s >= g.mark FROM g JOIN u ON u.user_id = g.user_id AND u.k = g.k + 1)
SELECT user_id, event_id FROM g WHERE took""")
def greedy_intervals(spark, sf):
    """The intervals a scan by start accepts, none overlapping another."""
    return intervals.greedy(_user(spark, sf), ["user_id"], "s", "e", ["s", "event_id"], zone=1 << 34).select("user_id", "event_id")


@query(f"""
WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM ({_USER})),
g AS (SELECT user_id, k, event_id, CASE WHEN ok THEN e ELSE -1 END AS mark, true AS took FROM u WHERE k = 1 UNION ALL
  SELECT u.user_id, u.k, u.event_id, CASE WHEN u.s >= g.mark AND u.ok THEN u.e ELSE g.mark END, u.s >= g.mark FROM g JOIN u ON u.user_id = g.user_id AND u.k = g.k + 1)
SELECT user_id, event_id FROM g WHERE took""")
def high_water(spark, sf):
    """Rows past the mark that accepted rows move."""
    return intervals.high_water(_user(spark, sf), ["user_id"], "s", "e", "ok", zone=1 << 34).select("user_id", "event_id")


@query(f"""
WITH u AS ({_USER}) SELECT user_id, event_id FROM u a WHERE event_type_ok AND NOT EXISTS (SELECT 1 FROM u b WHERE NOT b.event_type_ok AND a.user_id = b.user_id AND a.s < b.e AND b.s < a.e)""".replace("event_type_ok", "ok"))
def interval_anti_join(spark, sf):
    """Intervals that overlap none of another set."""
    u = _user(spark, sf)
    return intervals.outside(u.where("ok"), u.where("NOT ok"), ["user_id"], "s", "e", zone=1 << 34).select("user_id", "event_id")


@query(f"""
WITH u AS ({_USER}) SELECT a.user_id, a.event_id FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE b.event_id % 4 = 0 AND a.event_id % 4 <> 0 AND a.user_id = b.user_id AND a.s >= b.s AND a.s < b.e) AND a.event_id % 4 <> 0""")
def extent_restriction(spark, sf):
    """Offsets that lie in extents."""
    u = _user(spark, sf)
    return intervals.within(u.where("event_id % 4 <> 0"), u.where("event_id % 4 = 0"), ["user_id"], "s", "s", "e", zone=1 << 34).select("user_id", "event_id")


# --- joins, order, sets ----------------------------------------------------------------------------


_NODES = "SELECT p_partkey AS off, p_partkey - CASE WHEN p_partkey % 50 = 7 THEN 1 ELSE 0 END AS entry, p_name AS name, p_partkey // 2 AS parent FROM part"


@query(f"""
WITH RECURSIVE n AS ({_NODES}), i AS (SELECT * FROM n WHERE off IN (SELECT max(off) FROM n GROUP BY entry)),
w AS (SELECT off, entry, parent AS up, name AS path FROM n UNION ALL
  SELECT w.off, w.entry, i.parent, i.name || '/' || w.path FROM w JOIN i ON i.entry = w.up WHERE w.up NOT IN (0, 5))
SELECT off, entry, path FROM w WHERE up IN (0, 5) OR NOT EXISTS (SELECT 1 FROM i WHERE i.entry = w.up)""")
def resolved_paths(spark, sf):
    """Paths by parents, part k under part k div 2; some records share an entry, of which the last is the ancestor."""
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("off"), F.expr("p_partkey - CASE WHEN p_partkey % 50 = 7 THEN 1 ELSE 0 END").alias("entry"), F.col("p_name").alias("name"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return names.resolve_paths(nodes, order="off").select("off", "entry", "path")


@query("""
SELECT r_name || '/' || n_name || '/' || c_name AS path, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def directory_tree(spark, sf):
    """Three levels of parents, kinds of records in one adjacency table."""
    t = lambda n: table(spark, sf, n)
    nodes = names.union_all([
        t("region").select((F.col("r_regionkey") + 1_000_000_000).cast("long").alias("entry"), F.col("r_name").alias("name"), F.lit(0).cast("long").alias("parent")),
        t("nation").select((F.col("n_nationkey") + 2_000_000_000).cast("long").alias("entry"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1_000_000_000).cast("long").alias("parent")),
        t("customer").select((F.col("c_custkey") + 3_000_000_000).alias("entry"), F.col("c_name").alias("name"), (F.col("c_nationkey") + 2_000_000_000).cast("long").alias("parent")),
    ])
    return names.resolve_paths(nodes, depth=4).where("entry >= 3000000000").select("path", (F.col("entry") - 3_000_000_000).alias("c_custkey"))


@query("""SELECT o_orderkey * 256 AS off, (o_orderkey * 256 - 4096) // 1024 AS entry FROM orders WHERE o_orderkey * 256 >= 4096 AND (o_orderkey * 256 - 4096) % 1024 = 0""")
def entry_numbers(spark, sf):
    """Record numbers of aligned offsets."""
    return names.entry_numbers(table(spark, sf, "orders").select((F.col("o_orderkey") * 256).alias("off")), 4096, 1024)


@query("""SELECT s_suppkey, n_name, s_suppkey * g.cluster AS byte_offset FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (SELECT max(n_nationkey) * 512 AS cluster FROM nation) g""")
def geometry_applied(spark, sf):
    """One row of geometry applied to every record, and a lookup: both sides broadcast by their size."""
    nation = table(spark, sf, "nation")
    geometry = nation.agg((F.max("n_nationkey") * 512).alias("cluster"))
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.crossJoin(geometry).select("s_suppkey", "n_name", (F.col("s_suppkey") * F.col("cluster")).alias("byte_offset"))


@query("""
SELECT event_id, h.handler FROM events JOIN (VALUES ('click', 1, 'jpeg'), ('view', 2, 'png'), ('purchase', 3, 'riff')) h(sig, rank, handler) ON event_type = sig""")
def hit_handlers(spark, sf):
    """Hits meet their handlers."""
    handlers = spark.createDataFrame([("click", 1, "jpeg"), ("view", 2, "png"), ("purchase", 3, "riff")], "sig string, rank int, handler string")
    return table(spark, sf, "events").join(handlers, F.col("event_type") == F.col("sig")).select("event_id", "handler")


@query("""SELECT l_orderkey * 10 AS off, 1 AS sig_rank FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey * 10 AS off, 2 FROM lineitem WHERE l_linenumber = 2""")
def united_hits(spark, sf):
    """A bag of hits of two signatures, by offset and then by rank."""
    l = table(spark, sf, "lineitem").where("l_linenumber <= 2")  # noqa: E741
    return l.select((F.col("l_orderkey") * 10).alias("off"), F.col("l_linenumber").alias("sig_rank")).orderBy("off", "sig_rank")


@query("""SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 100""")
def directory_order(spark, sf):
    """The first entries by name: a limit that is the feature."""
    return table(spark, sf, "pages").select("page_id", "url").orderBy("url", "page_id").limit(100)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 5000""")
def row_cap(spark, sf):
    """The first rows by offset: the reader's cap, which is its feature."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(5000)


# --- text ------------------------------------------------------------------------------------------


@query(r"""
WITH r AS (SELECT page_id, regexp_extract_all(html, '[\t\n\r\x20-\x7e]{160}[\t\n\r\x20-\x7e]*') AS runs FROM pages)
SELECT page_id, (i - 1)::INT AS run_no, length(runs[i])::BIGINT AS length, sha256(runs[i]) AS digest FROM (SELECT page_id, runs, unnest(range(1, len(runs) + 1)) AS i FROM r)""")
def text_runs(spark, sf):
    """Printable runs of at least 160 bytes in pages: the flagship."""
    rows = text.run_rows(table(spark, sf, "pages").select("page_id", _bytes("html").alias("d")), "d")
    return rows.select("page_id", "run_no", "length", F.sha2(F.encode("run", "ISO-8859-1"), 256).alias("digest"))


def _sql_rules(column: str) -> str:
    per = []
    for k, (name, ext, strong, weak) in enumerate(LANGUAGES):
        def hit(p: str) -> str:
            p = p.replace("'", "''")
            return f"CASE WHEN regexp_matches({column}, '{p}') THEN 1 ELSE 0 END"

        hard, soft = "(" + " + ".join(map(hit, strong)) + ")", "(" + " + ".join(map(hit, weak)) + ")"
        per.append(f"{{'score': CASE WHEN {hard} > 0 THEN {hard} * {STRONG} + {soft} * {WEAK} ELSE 0 END, 'rank': {-k}, 'language': '{name}', 'ext': '{ext}'}}")
    return "list_max([" + ", ".join(per) + "])"


_SNIPPETS = [
    "fn main() { let mut x = 1; println!(\"{}\", x); }",
    "import androidx.lifecycle\nclass A : ViewModel() { val x: Int = 1 }",
    "import os\nfrom a.b import c\nclass A(object):\n    def f(self):\n        return self.x\n",
    "pragma solidity ^0.8;\ncontract A { mapping(address => uint256) m; }",
    "const a = require('x');\nmodule.exports = () => { console.log(a) }",
    "package main\nimport (\"fmt\")\nfunc main() { defer fmt.Println(1) }",
    "#include <stdio.h>\nint main(void) { printf(\"x\"); return 0; }",
    "{\"a\": {\"b\": 1}}",
    "[package]\nname = \"x\"\nversion = \"1\"\n",
    "# Title\n\n- one\n- two [a](b)\n",
    "nothing of any kind",
]
_VALUES = ", ".join("({}, '{}')".format(k, s.replace("'", "''")) for k, s in enumerate(_SNIPPETS))
_CORPUS = f"SELECT 'event' AS kind, event_id AS id, props AS t FROM events UNION ALL SELECT 'snippet', i, s FROM (VALUES {_VALUES}) v(i, s)"


@query(f"""
SELECT kind, id, CASE WHEN b.score >= {LEAST} THEN b.language END AS language, CASE WHEN b.score >= {LEAST} THEN b.ext END AS ext, CASE WHEN b.score >= {LEAST} THEN b.score ELSE 0 END AS score
FROM (SELECT kind, id, {_sql_rules('t')} AS b FROM ({_CORPUS}))""")
def language_scores(spark, sf):
    """Languages of event properties and of one snippet of each."""
    snippets = spark.createDataFrame([("snippet", k, s) for k, s in enumerate(_SNIPPETS)], "kind string, id long, t string")
    rows = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("t")).unionByName(snippets)
    return rows.select("kind", "id", text.classified(F.col("t")).alias("b")).select("kind", "id", "b.*")


@query(f"""
SELECT language, count(*) AS n FROM (SELECT CASE WHEN b.score >= {LEAST} THEN b.language ELSE 'none' END AS language FROM (SELECT {_sql_rules('props')} AS b FROM events)) GROUP BY language""")
def language_counts(spark, sf):
    rows = table(spark, sf, "events").select(F.coalesce(text.classified(F.col("props"))["language"], F.lit("none")).alias("language"))
    return aggregates.class_counts(rows, ["language"])


_KEPT = 600


@query(rf"""
WITH r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\t\n\r\x20-\x7e]{{160}}[\t\n\r\x20-\x7e]*') AS runs FROM documents),
e AS (SELECT doc_id, (i - 1)::INT AS run_no, runs[i] AS run FROM (SELECT doc_id, runs, unnest(range(1, len(runs) + 1)) AS i FROM r)),
s AS (SELECT doc_id, run_no, length(run)::BIGINT AS length, {_sql_rules('run')} AS b FROM e)
SELECT * FROM (SELECT doc_id, run_no, length, CASE WHEN b.score >= {LEAST} THEN b.language WHEN length >= {_KEPT} THEN 'other' END AS language FROM s) WHERE language IS NOT NULL""")
def kept_unknown(spark, sf):
    """Every printable run of every document: its language, or ``other`` if it is long and of none."""
    rows = text.run_rows(table(spark, sf, "documents").select("doc_id", _bytes("text").alias("d")), "d")
    language = text.kept_language(text.classified(F.col("run")), F.col("length"))
    return rows.select("doc_id", "run_no", "length", language.alias("language")).where("language IS NOT NULL")


@query()
def crc_tags(spark, sf):
    """crc32 of every text, for checks of carved members. Without SQL: the query is tested against zlib over a whole table."""
    return table(spark, sf, "documents").select("doc_id", F.crc32(_bytes("text")).alias("crc"))
