"""The engine's own queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore import reports
from lodestore.functions import objects as B
from lodestore.functions import oid as O
from lodestore.operators import delta, graph, index, lookup
from lodestore.plans import binary, store, synth
from lodestore.session import stash

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: The content id of a text, and the id of a name, in DuckDB.
_BLOB = "sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text))"
_IDS = f"ids AS (SELECT doc_id, {_BLOB} AS oid FROM documents)"


def _name(kind: str, *key: str) -> str:
    return f"sha1('{kind}:' || " + " || ':' || ".join(key) + ")"


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# identifiers and blobs


@query(f"SELECT doc_id, {_BLOB} AS oid FROM documents")
def blob_oid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.blob_ids(spark, sf_dir)


@query("SELECT doc_id, 'blob' AS type, octet_length(encode(text)) AS size, sha1(text) AS sha FROM documents")
def loose_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.loose_round_trip(synth.table(spark, sf_dir, "documents"))


@query("SELECT doc_id, 'blob' AS type, octet_length(encode(text)) AS size FROM documents")
def loose_header_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.loose_headers(synth.table(spark, sf_dir, "documents"))


@query("SELECT doc_id, 'blob' AS type, octet_length(encode(text)) AS size, sha1(text) AS sha FROM documents")
def object_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("text").cast("string")), "utf-8"), F.unhex(F.lit("00")), synth.text_bytes())
    kind, size, payload = B.split_object(F.col("raw"))
    return synth.table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", kind.alias("type"), size.alias("size"), F.sha1(payload).alias("sha"))


@query("SELECT doc_id, text, CAST(length(text) AS BIGINT) AS chars FROM documents")
def blob_utf8_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = B.utf8_strict(synth.text_bytes())
    return synth.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.length(text).cast("bigint").alias("chars"))


@query("SELECT page_id, html || chr(65533) AS html, true AS bad FROM pages")
def blob_utf8_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(synth.text_bytes("html"), F.unhex(F.lit("FF")))
    return synth.table(spark, sf_dir, "pages").select("page_id", B.utf8_lossy(raw).alias("html"), B.utf8_or_null(raw).isNull().alias("bad"))


@query(f"WITH {_IDS} SELECT doc_id, oid, substr(oid, 1, 32) AS oid32, CAST('0x' || substr(oid, 33, 8) AS BIGINT) AS rest, CAST('0x' || substr(oid, 1, 2) AS BIGINT) AS first_byte, oid AS again, 'objects/' || substr(oid, 1, 2) || '/' || substr(oid, 3) AS path, oid AS from_path FROM ids")
def oid_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    oid = F.col("oid")
    head, rest = O.parts(oid)
    path = O.loose_path("objects", oid)
    return synth.blob_ids(spark, sf_dir).select("doc_id", "oid", head.alias("oid32"), rest.alias("rest"), O.first_byte(oid).cast("bigint").alias("first_byte"), O.from_parts(head, rest).alias("again"), path.alias("path"), O.from_path(path).alias("from_path"))


# lookup


@query(f"WITH {_IDS} SELECT DISTINCT oid FROM ids WHERE starts_with(oid, 'a')")
def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.distinct_ids(synth.blob_ids(spark, sf_dir), "A")


@query(f"WITH {_IDS} SELECT substr(oid, 1, 2) AS prefix, count(DISTINCT oid) AS candidates, min(oid) AS first_oid FROM ids GROUP BY 1")
def prefix_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = synth.blob_ids(spark, sf_dir).select("oid").distinct()
    return ids.groupBy(F.substring("oid", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("candidates"), F.min("oid").alias("first_oid"))


@query(f"WITH {_IDS}, asked AS (SELECT DISTINCT substr(sha1(CAST(s_suppkey AS VARCHAR)), 1, 2 + CAST(s_suppkey % 3 AS INTEGER)) AS prefix FROM supplier) SELECT prefix, doc_id, oid FROM ids JOIN asked ON starts_with(oid, prefix)")
def multi_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha1(F.encode(F.col("s_suppkey").cast("string"), "utf-8"))
    asked = synth.table(spark, sf_dir, "supplier").select(F.substring(key, F.lit(1), (2 + F.col("s_suppkey") % 3).cast("int")).alias("prefix"))
    return lookup.join_prefixes(synth.blob_ids(spark, sf_dir), asked).select("prefix", "doc_id", "oid")


@query(f"WITH {_IDS} SELECT doc_id, oid FROM ids WHERE oid IN (SELECT {_BLOB} FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)))")
def oid_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of conversations, of the benchmark and of labelled documents, looked up among all documents."""
    docs = synth.blobs(spark, sf_dir)
    texts = [synth.table(spark, sf_dir, t).select("text") for t in ("conversations", "benchmark")]
    asked = texts[0].unionByName(texts[1]).select(B.object_id("blob", synth.text_bytes()).alias("oid"))
    asked = asked.unionByName(docs.join(synth.table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("oid"))
    return lookup.select_ids(docs.select("doc_id", "oid"), asked)


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source are loose, the rest are packed by source; copies then lie in several places."""
    loose = F.col("source") == "src0"
    return synth.blobs(spark, sf_dir).select("oid", F.when(loose, "loose").otherwise("packed").alias("store"), F.when(loose, O.loose_path("objects", F.col("oid"))).alias("path"), F.when(~loose, F.col("source")).alias("pack_id"), F.when(~loose, F.col("doc_id")).alias("offset"))


_PLACES = f"places AS (SELECT {_BLOB} AS oid, CASE WHEN source = 'src0' THEN 'loose' ELSE 'packed' END AS store, CASE WHEN source = 'src0' THEN NULL ELSE source END AS pack_id, CASE WHEN source = 'src0' THEN NULL ELSE doc_id END AS \"offset\" FROM documents)"


@query(f"WITH {_PLACES} SELECT oid, store, pack_id, \"offset\" FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY store, pack_id, \"offset\") AS r FROM places) WHERE r = 1")
def first_match_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_match(_locations(spark, sf_dir)).select("oid", "store", "pack_id", "offset")


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.blob_ids(spark, sf_dir).select("oid").distinct()


@query(f"WITH {_IDS} SELECT doc_id, substr(oid, 1, 32) AS short_oid, oid AS back, oid AS from_names, oid AS from_long, CAST(NULL AS VARCHAR) AS from_text, oid AS pack, oid AS pack_of_index, CAST(NULL AS VARCHAR) AS pack_of_other FROM ids")
def oid_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from and to text, bytes and names, upper case and longer text included; what is no id is null."""
    oid = F.col("oid")
    rows = synth.blobs(spark, sf_dir)
    names = O.from_folder_and_file(F.substring(oid, 1, 2), F.substring(oid, 3, 38))
    return rows.select(
        "doc_id", O.truncated(F.upper(oid)).alias("short_oid"), O.from_bytes(O.to_bytes(oid)).alias("back"), names.alias("from_names"), O.full(F.concat(F.upper(oid), F.lit(" and more"))).alias("from_long"),
        O.full(F.concat(F.lit("no id: "), "text")).alias("from_text"), O.pack_id(O.pack_path("objects", oid)).alias("pack"), O.pack_id(O.pack_path("objects", oid, "idx")).alias("pack_of_index"), O.pack_id(O.loose_path("objects", oid)).alias("pack_of_other"),
    )


# sorted index


_ONCE = f"WITH {_IDS}, once AS (SELECT DISTINCT oid FROM ids)"


@query(f"{_ONCE} SELECT b AS byte, count(oid) AS objects, CAST(sum(count(oid)) OVER (ORDER BY b) AS BIGINT) AS cumulative FROM (SELECT unnest(range(256)) AS b) LEFT JOIN once ON CAST('0x' || substr(oid, 1, 2) AS BIGINT) = b GROUP BY b")
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.fanout(_ids(spark, sf_dir))


@query(f"{_ONCE} SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS idx_pos FROM once")
def idx_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.positions(_ids(spark, sf_dir))


@query(f"{_ONCE}, placed AS (SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS idx_pos FROM once) SELECT * FROM placed WHERE oid >= 'c8'")
def idx_range_from_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.from_byte(index.positions(_ids(spark, sf_dir)), 0xC8)


@query(f"{_ONCE} SELECT bits, CAST('0x' || substr(oid, 1, 4) AS BIGINT) >> (16 - bits) AS bucket, count(*) AS objects FROM once, (SELECT unnest([8, 10]) AS bits) GROUP BY 1, 2")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _ids(spark, sf_dir)
    return index.bucket_report(ids, 8).withColumn("bits", F.lit(8)).unionByName(index.bucket_report(ids, 10).withColumn("bits", F.lit(10)))


@query(f"{_ONCE}, b AS (SELECT CAST('0x' || substr(oid, 1, 3) AS BIGINT) >> 2 AS bucket, count(*) AS n FROM once GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS objects, CAST(1024 AS BIGINT) AS buckets, count(*) AS used, CASE WHEN count(*) < 1024 THEN 0 ELSE min(n) END AS least, max(n) AS most, CAST(sum(n) AS BIGINT) / 1024.0::DOUBLE AS mean FROM b")
def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.table_report(_ids(spark, sf_dir), 10)


@query(f"WITH {_IDS} SELECT doc_id, oid FROM ids WHERE oid BETWEEN '2' AND '3fffffff'")
def oid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.between(synth.blob_ids(spark, sf_dir), "2", "3fffffff")


_LAID = f"laid AS (SELECT doc_id // 1000 AS pack, doc_id, {_BLOB} AS oid, CAST(12 + sum(n_chars) OVER w - n_chars AS BIGINT) AS \"offset\", CAST(12 + sum(n_chars) OVER w AS BIGINT) AS end_offset FROM documents WINDOW w AS (PARTITION BY doc_id // 1000 ORDER BY doc_id))"
_POS = 'row_number() OVER (PARTITION BY pack ORDER BY oid, "offset") - 1 AS idx_pos'


@query(f"WITH {_LAID} SELECT pack, oid, {_POS}, \"offset\" FROM laid")
def idx_roundtrip_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.index_round_trip(synth.packed(spark, sf_dir), 1)


@query(f"WITH {_LAID} SELECT pack, oid, {_POS}, \"offset\" + 3000000000 AS \"offset\" FROM laid")
def idx_roundtrip_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets beyond 31 bits, which go to the table of wide ones."""
    return binary.index_round_trip(synth.packed(spark, sf_dir).withColumn("offset", F.col("offset") + 3_000_000_000), 2)


@query(f"WITH {_LAID} SELECT pack, oid, \"offset\", end_offset - \"offset\" AS size_in_pack FROM laid")
def size_in_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synth.packed(spark, sf_dir).select(F.col("pack").alias("pack_id"), "oid", "offset", (F.col("last") + 20).alias("pack_size"))
    packs = rows.groupBy("pack_id").agg(F.max("pack_size").alias("pack_size"))
    return index.size_in_pack(rows.drop("pack_size"), packs).select(F.col("pack_id").alias("pack"), "oid", "offset", "size_in_pack")


# packs and deltas


@query("SELECT doc_id, ['commit', 'tree', 'blob', 'tag'][1 + CAST(doc_id % 4 AS INTEGER)] AS phys_type, n_chars AS inflated_size FROM documents")
def pack_header_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.entry_headers(synth.table(spark, sf_dir, "documents"))


@query("SELECT doc_id, n_chars * (doc_id + 1) AS value FROM documents")
def ofs_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.offset_varints(synth.table(spark, sf_dir, "documents"))


@query("SELECT doc_id, sha1(text || chr(10) || 'one more line') AS sha, octet_length(encode(text)) + 14 AS size FROM documents")
def delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.deltas(synth.table(spark, sf_dir, "documents"), "\none more line")


_SO_FAR = "string_agg(text, '' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn)"


@query(f"SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'blob' ELSE 'ofs_delta' END AS phys_type, octet_length(encode(t)) AS size, sha1(t) AS sha FROM (SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)")
def delta_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.delta_chains(synth.table(spark, sf_dir, "conversations"))


@query(f"SELECT conv_id, turn, turn AS depth, {_name('commit', 'conv_id', '0')} AS root_oid FROM conversations")
def delta_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth.turns(spark, sf_dir)
    found = graph.roots(t.select(F.col("oid").alias("node"), "parent"))
    return t.join(found, t.oid == found.node).select("conv_id", "turn", "depth", F.col("root").alias("root_oid"))


@query(f"""SELECT conv_id, turn, {_name('commit', 'conv_id', 'turn')} || ' blob   ' || octet_length(encode(text)) || ' ' || octet_length(encode(text)) || ' ' || off
  || CASE WHEN turn > 0 THEN ' ' || turn || ' ' || {_name('commit', 'conv_id', '(turn - 1)')} ELSE '' END AS line
FROM (SELECT *, CAST(12 + sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn) - octet_length(encode(text)) AS BIGINT) AS off FROM conversations)""")
def verify_pack_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a pack whose turns are deltas over the turn before."""
    from pyspark.sql.window import Window

    t = synth.turns(spark, sf_dir).withColumn("n", F.octet_length("text").cast("bigint"))
    end = 12 + F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("end", end)
    last = F.max("end").over(Window.partitionBy("conv_id"))
    t = t.select("conv_id", "turn", "oid", "parent", F.col("parent").alias("base_oid"), F.col("n").alias("inflated_size"), F.col("conv_id").alias("pack_id"), (F.col("end") - F.col("n")).alias("offset"), (last + 20).alias("pack_size"))
    rows = index.size_in_pack(t.drop("pack_size", "parent"), t.groupBy("pack_id").agg(F.max("pack_size").alias("pack_size")))
    found = graph.roots(t.select(F.col("oid").alias("node"), "parent")).select(F.col("node").alias("oid"), "depth")
    return rows.join(found, "oid").withColumn("type", F.lit("blob")).select("conv_id", "turn", reports.pack_line().alias("line"))


# commits


_PERSON = "role || ' <' || role || '@x.org> ' || (conv_id * 1000 + turn) || ' +0000'"
_PARENT = f"CASE WHEN turn > 0 THEN {_name('commit', 'conv_id', '(turn - 1)')} ELSE '' END"


def _commits(spark: SparkSession, sf_dir: str, message=None, extra=None) -> DataFrame:
    return synth.commit_bytes(synth.turns(spark, sf_dir), F.col("text") if message is None else message, extra)


def _flat(parsed: DataFrame) -> DataFrame:
    """Parents as one string, since results carry no arrays."""
    return parsed.withColumn("parents", F.array_join("parents", ",")) if "parents" in parsed.columns else parsed


@query(f"SELECT conv_id, turn, {_name('tree', 'conv_id')} AS tree, {_PARENT} AS parents, {_PERSON} AS author, {_PERSON} AS committer, text AS message FROM conversations")
def commit_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_commits(spark, sf_dir, F.concat("text", F.lit("\n\n"))).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "full")))


@query(f"SELECT conv_id, turn, {_PARENT} AS parents, split_part(text, chr(10), 1) AS subject FROM conversations")
def commit_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_commits(spark, sf_dir).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "parents_subject")))


@query(f"SELECT conv_id, turn, {_name('tree', 'conv_id')} AS tree, {_PARENT} AS parents, {_PERSON} AS author, {_PERSON} AS committer, split_part(text, chr(10), 1) AS subject FROM conversations")
def commit_full_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_commits(spark, sf_dir).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "full_subject")))


@query(f"SELECT conv_id, turn, {_name('tree', 'conv_id')} AS tree, {_PARENT} AS parents, split_part(text, chr(10), 1) AS subject FROM conversations")
def commit_tree_parents_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_commits(spark, sf_dir).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "tree_parents_subject")))


@query(f"SELECT conv_id, turn, {_name('tree', 'conv_id')} AS tree, {_PARENT} AS parents FROM conversations")
def commit_tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_commits(spark, sf_dir).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "tree_parents")))


@query(f"SELECT conv_id, turn, substr({_PARENT}, 1, 32) AS parents, split_part(text, chr(10), 1) AS subject FROM conversations")
def commit_short_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents as truncated ids, with the subject."""
    parsed = _commits(spark, sf_dir).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "parents_subject"))
    return _flat(parsed.withColumn("parents", F.transform("parents", lambda p: O.short(p))))


@query("SELECT conv_id, turn, split_part(text, chr(10), 1) AS subject, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS description FROM conversations")
def commit_msg_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank line after the first line, and more at the end."""
    message = F.concat(F.regexp_replace("text", "^([^\n]*)\n", "$1\n\n"), F.lit("\n\n"))
    return _commits(spark, sf_dir, message).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "subject_and_description")).select("conv_id", "turn", "subject", "description")


@query(f"SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS pos, {_name('part', 'l_partkey')} AS parent FROM lineitem")
def commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of many parents, their parts in the order of lines."""
    lines = synth.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ps"))
    parents = F.transform("ps", lambda p: synth.name_id("part", p["l_partkey"]))
    who = F.lit("a <a@x.org> 0 +0000")
    payload = B.encode_commit(F.sha1(F.lit(b"t")), parents, who, who, F.lit("m"))
    parsed = lines.select("l_orderkey", B.commit_field(payload, "parents").alias("parents"))
    return parsed.select(F.col("l_orderkey").alias("o_orderkey"), F.posexplode("parents").alias("pos", "parent")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"SELECT conv_id, turn, {_PARENT} AS parents, {_PERSON} AS committer, text AS message FROM conversations")
def commit_extra_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and merged tags, whose lines go on after a blank, between committer and message."""
    sign = "gpgsig -----BEGIN PGP SIGNATURE-----\n \n abc\n -----END PGP SIGNATURE-----\n"
    tag = f"mergetag object {'a' * 40}\n type commit\n tag v1\n tagger t <t> 0 +0000\n \n author in a tag\n parent {'b' * 40}\n"
    extra = F.when(F.col("turn") % 2 == 1, F.lit(sign + tag)).otherwise("encoding UTF-8\n")
    parsed = _commits(spark, sf_dir, None, extra).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "full"))
    return _flat(parsed).select("conv_id", "turn", "parents", "committer", "message")


@query(f"SELECT conv_id, turn, {_name('tree', 'conv_id')} AS tree, {_PARENT} AS parents, {_PERSON} AS author, {_PERSON} AS committer FROM conversations")
def commit_no_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_commits(spark, sf_dir, F.lit("")).select("conv_id", "turn", *B.parse_commit(F.col("payload"), "no_message")))


@query(f"SELECT conv_id, turn, 'tree ' || {_name('tree', 'conv_id')} || chr(10) || CASE WHEN turn > 0 THEN 'parent ' || {_PARENT} || chr(10) ELSE '' END || 'author ' || {_PERSON} || chr(10) || 'committer ' || {_PERSON} || chr(10) || chr(10) || text AS shown FROM conversations")
def commit_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _commits(spark, sf_dir).select("conv_id", "turn", F.lit("commit").alias("type"), "oid", "payload")
    parts = B.parse_commit(F.col("payload"), "full")
    return found.select("conv_id", "turn", B.render_commit(*parts).alias("shown"))


@query("SELECT event_id, 'user' || user_id AS name, 'user' || user_id || '@x.org' AS email, epoch_us(ts) // 1000000 AS seconds, '+0000' AS zone FROM events")
def author_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    line = synth.person(name, F.unix_seconds(F.col("ts").cast("timestamp")))
    return synth.table(spark, sf_dir, "events").select("event_id", line.alias("line")).select("event_id", *(c.alias(k) for k, c in B.person(F.col("line")).items()))


@query("SELECT conv_id, turn, 'v' || turn AS tag, 'commit' AS object_type, text AS message FROM conversations")
def tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("object "), "oid", F.lit("\ntype commit\ntag v"), F.col("turn").cast("string"), F.lit("\ntagger "), synth.person(F.col("role"), F.col("turn")), F.lit("\n\n"), "text", F.lit("\n"))
    parsed = synth.turns(spark, sf_dir).select("conv_id", "turn", F.encode(head, "utf-8").alias("payload")).select("conv_id", "turn", *B.parse_tag(F.col("payload")))
    return parsed.select("conv_id", "turn", "tag", "object_type", "message")


# trees


_ENTRIES = f"""entries AS (
  SELECT {_name('region', 'n_regionkey')} AS tree_oid, '040000' AS mode, 'tree' AS kind, n_name AS name, {_name('nation', 'n_nationkey')} AS oid FROM nation
  UNION ALL SELECT {_name('nation', 's_nationkey')}, CASE WHEN s_suppkey % 2 = 0 THEN '100755' ELSE '100644' END, 'blob', s_name, {_name('supplier', 's_suppkey')} FROM supplier)"""


@query(f"WITH {_ENTRIES} SELECT tree_oid, row_number() OVER (PARTITION BY tree_oid ORDER BY name, oid) - 1 AS pos, mode, kind, name, oid FROM entries")
def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.tree_entries(synth.region_trees(spark, sf_dir))


@query(f"WITH {_ENTRIES} SELECT tree_oid, string_agg(mode || ' ' || kind || ' ' || oid || chr(9) || name, chr(10) ORDER BY name, oid) AS shown FROM entries GROUP BY tree_oid")
def tree_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.region_trees(spark, sf_dir).select("tree_oid", B.render_tree(B.parse_tree(F.col("payload"))).alias("shown"))


@query(f"SELECT {_name('region', 'r_regionkey')} AS root, n_name || '/' || s_name AS path, {_name('supplier', 's_suppkey')} AS oid FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def walk_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = synth.table(spark, sf_dir, "region").select(synth.name_id("region", "r_regionkey").alias("root"))
    return graph.descend(lambda ids: synth.tree_entries(synth.region_trees(spark, sf_dir).join(ids, "tree_oid", "left_semi")), start).select("root", "path", "oid")


# history


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synth.turns(spark, sf_dir)
    return t.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(synth.name_id("commit", "conv_id", "turn").alias("oid"))


def _log(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    commits = _commits(spark, sf_dir).select("oid", *B.parse_commit(F.col("payload"), "parents_subject"))
    return reports.log(commits, _heads(spark, sf_dir), limit).select("head", "depth", "oid", "line")


_LOG = f"SELECT {_name('commit', 'conv_id', 'latest')} AS head, latest - turn AS depth, {_name('commit', 'conv_id', 'turn')} AS oid, {_name('commit', 'conv_id', 'turn')} || ' ' || split_part(text, chr(10), 1) AS line FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS latest FROM conversations)"


@query(_LOG)
def log_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir, None)


@query(f"SELECT * FROM ({_LOG}) WHERE depth < 3")
def log_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each history: the limit is the feature."""
    return _log(spark, sf_dir, 3)


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS distance FROM orders")
def ancestor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a chain."""
    from pyspark.sql.window import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = synth.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), before.alias("parent"))
    return graph.roots(edges).select(F.col("node").alias("o_orderkey"), "root", F.col("depth").alias("distance"))


@query(f"SELECT DISTINCT {_name('document', 'doc_id')} AS oid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dangling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents that the labels don't have."""
    documents, labels = (synth.table(spark, sf_dir, t).select(synth.name_id("document", "doc_id").alias("oid")) for t in ("documents", "labels"))
    return lookup.missing_ids(documents, labels)


# a store on disk


_S = f"WITH {store.SQL}"
_AT = "CASE WHEN store = 'loose' THEN substr(oid, 1, 2) || '/' || substr(oid, 3) ELSE 'pack/pack-' || pack_id || '.pack' END"
_COPIES = "copies AS (SELECT oid, 'loose' AS store, CAST(NULL AS VARCHAR) AS pack_id FROM loose UNION ALL SELECT oid, 'packed', pack_id FROM packed)"


def _below(db, column: str = "path"):
    """A path without the store's own."""
    return F.substring(F.col(column), len(db.path) + 2, 1 << 20)


@query(f"{_S} SELECT oid, type, octet_length(payload) AS size, sha1(payload) AS sha, store FROM once")
def store_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of the store, inflated and rebuilt."""
    return store.store(spark, sf_dir).objects().select("oid", "type", "size", store.sha().alias("sha"), "store")


@query(f"{_S} SELECT oid, type FROM once")
def store_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store(spark, sf_dir).kinds()


@query(f"{_S}, {_COPIES} SELECT oid, store, pack_id, {_AT} AS place FROM copies")
def store_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store.store(spark, sf_dir)
    return db.locations().select("oid", "store", "pack_id", _below(db).alias("place"))


@query(f"{_S}, {_COPIES} SELECT oid FROM copies")
def union_all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids, a row for every copy."""
    return store.store(spark, sf_dir).ids()


@query(f"{_S} SELECT oid FROM once")
def list_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_ids(store.store(spark, sf_dir))


@query(f"{_S} SELECT pack_id, CASE WHEN kind = 'c' THEN 1 ELSE 2 END AS idx_version, CASE WHEN kind = 'c' THEN 3 ELSE 2 END AS pack_version, count(DISTINCT oid) AS num_objects FROM (SELECT 'c' AS kind, pack_id, oid FROM conv_packed UNION ALL SELECT 'd', pack_id, oid FROM doc_packed) GROUP BY kind, pack_id")
def store_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = store.store(spark, sf_dir)
    return db.packs().select("pack_id", "idx_version", "pack_version", "num_objects")


@query(f"{_S}, {_COPIES} SELECT 'loose' AS kind, oid FROM loose WHERE starts_with(oid, 'a') UNION ALL SELECT 'packed', oid FROM packed WHERE starts_with(oid, 'a') UNION ALL SELECT 'any', oid FROM copies WHERE starts_with(oid, 'ab') UNION ALL SELECT 'folder', oid FROM loose WHERE starts_with(oid, 'ab') UNION ALL SELECT 'distinct', oid FROM once WHERE starts_with(oid, 'a')")
def store_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose, packed and all ids with a prefix, with copies and without."""
    db = store.store(spark, sf_dir)
    found = {"loose": db.loose_ids("a"), "packed": db.entries("A"), "any": db.locations("ab"), "folder": db.loose_ids("ab"), "distinct": reports.resolve_ambiguous(db, "a")}
    frames = [df.select(F.lit(k).alias("kind"), "oid") for k, df in found.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


@query(f"{_S}, {_COPIES}, most AS (SELECT oid FROM copies GROUP BY oid ORDER BY count(*) DESC, oid LIMIT 1) SELECT oid, store, {_AT} AS place FROM copies WHERE oid IN (SELECT oid FROM most)")
def which_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the object that has most."""
    db = store.store(spark, sf_dir)
    one = db.ids().groupBy("oid").count().orderBy(F.desc("count"), "oid").first().oid
    return reports.which_pack(db, one).select("oid", "store", _below(db).alias("place"))


_SIZED = "row_number() OVER (PARTITION BY pack_id ORDER BY oid) - 1 AS idx_pos"


@query(f"{_S} SELECT pack_id, {_SIZED}, oid, \"offset\" || ' ' || oid AS line, true AS crc_holds FROM doc_placed")
def show_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every index of documents, with positions; checksums, which DuckDB lacks, are held against the packs."""
    db = store.store(spark, sf_dir)
    own = db.packs().filter("idx_version = 2").select("pack_id")
    line = F.regexp_replace(reports.index_line(), r" \([0-9a-f]{8}\)$", "")
    rows = delta.raw_checksums(db.headers().join(own, "pack_id", "left_semi"))
    return rows.select("pack_id", "idx_pos", "oid", line.alias("line"), (F.col("crc32") == F.col("stored_crc32")).alias("crc_holds"))


@query(f"{_S} SELECT pack_id, oid, {_SIZED} FROM (SELECT DISTINCT pack_id, oid FROM packed)")
def store_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every index, of both versions."""
    return store.store(spark, sf_dir).entries().select("pack_id", "oid", "idx_pos")


@query(f"{_S} SELECT pack_id, \"offset\", oid || ' blob   ' || size || ' ' || size_in_pack || ' ' || \"offset\" AS line FROM doc_placed")
def verify_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of every pack of documents, whose places follow from their sizes."""
    db = store.store(spark, sf_dir)
    own = db.packs().filter("idx_version = 2")
    rows = index.size_in_pack(db.resolved().join(own.select("pack_id"), "pack_id", "left_semi"), own)
    return rows.select("pack_id", "offset", reports.pack_line().alias("line"))


@query(f"{_S} SELECT pack_id, oid, phys_type, type, depth, base_oid FROM conv_packed UNION ALL SELECT pack_id, oid, 'blob', 'blob', 0, NULL FROM doc_packed")
def objects_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, depth and base of every packed object, through chains of deltas by offset and by id."""
    return store.store(spark, sf_dir).resolved().select("pack_id", "oid", "phys_type", "type", "depth", "base_oid")


_SHOWN = """shown AS (
  SELECT DISTINCT commit AS oid, 'commit' AS type, payload AS text FROM turns
  UNION ALL SELECT tag, 'tag', tag_text FROM tagged
  UNION ALL SELECT oid, 'blob', decode(payload) FROM once WHERE type = 'blob'
  UNION ALL SELECT DISTINCT tree, 'tree', '100755 blob ' || blob || chr(9) || 'latest' || chr(10) || '040000 tree ' || folder || chr(9) || 'turns' FROM turns
  UNION ALL SELECT DISTINCT folder, 'tree', string_agg('100644 blob ' || blob || chr(9) || 'turn-' || lpad(CAST(turn AS VARCHAR), 4, '0') || '.txt', chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) FROM turns)"""


@query(f"{_S}, {_SHOWN} SELECT oid, type, text FROM shown")
def render_cat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every object of the store."""
    return reports.render(store.store(spark, sf_dir).objects())


@query(f"{_S}, {_SHOWN} SELECT oid, type, text FROM shown WHERE oid IN (SELECT min(oid) FROM once GROUP BY type)")
def cat_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first object of each type by a prefix that no other has: its bucket and its chain are read, no more."""
    db = store.store(spark, sf_dir)
    out = None
    for r in db.kinds().groupBy("type").agg(F.min("oid").alias("oid")).orderBy("type").collect():
        shown = reports.cat_file(db, r.oid[:16])
        out = shown if out is None else out.unionByName(shown)
    return out


@query(f"{_S} SELECT oid, type, octet_length(payload) AS size, sha1(payload) AS sha, store FROM once WHERE oid IN (SELECT oid FROM blobs UNION ALL SELECT commit FROM turns)")
def store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of given ids, of all documents and commits, each by its own chain."""
    db = store.store(spark, sf_dir)
    ids = synth.blob_ids(spark, sf_dir).select("oid").unionByName(db.commits("parents").select("oid"))
    return db.fetch(ids).select("oid", "type", "size", store.sha().alias("sha"), "store")


@query(f"{_S} SELECT commit AS oid, tree, coalesce(parent, '') AS parents, {_PERSON} AS author, {_PERSON} AS committer, split_part(text, chr(10), 1) AS subject FROM turns")
def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(store.store(spark, sf_dir).commits("full_subject"))


@query(f"""{_S} SELECT DISTINCT tree AS tree_oid, unnest([0, 1]) AS pos, unnest(['100755', '040000']) AS mode, unnest(['blob', 'tree']) AS kind, unnest(['latest', 'turns']) AS name, unnest([blob, folder]) AS oid FROM turns
  UNION ALL SELECT DISTINCT t.folder, u.turn, '100644', 'blob', 'turn-' || lpad(CAST(u.turn AS VARCHAR), 4, '0') || '.txt', u.blob FROM turns t JOIN turns u ON u.conv_id = t.conv_id AND u.turn <= t.turn""")
def store_tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.store(spark, sf_dir).tree_entries().withColumn("pos", F.col("pos").cast("bigint"))
    return rows.select("tree_oid", "pos", "mode", "kind", "name", "oid")


@query(f"{_S} SELECT tag AS oid, commit AS object, 'commit' AS object_type, 'v' || conv_id AS tag, {_PERSON} AS tagger, text AS message FROM tagged")
def store_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store(spark, sf_dir).tags()


@query(f"{_S} SELECT oid, octet_length(payload) AS size, decode(payload) AS text FROM once WHERE type = 'blob'")
def store_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store(spark, sf_dir).blobs().select("oid", "size", "text")


_LOGGED = "logged AS (SELECT h.commit AS head, h.turn - t.turn AS depth, t.commit AS oid, t.commit || ' ' || split_part(t.text, chr(10), 1) AS line FROM turns h JOIN turns t ON t.conv_id = h.conv_id AND t.turn <= h.turn WHERE h.turn = (SELECT max(turn) FROM conversations c WHERE c.conv_id = h.conv_id))"


def _store_heads(commits: DataFrame) -> DataFrame:
    """Commits that are no other's parent."""
    return lookup.missing_ids(commits, commits.select(F.explode("parents").alias("oid")))


@query(f"{_S}, {_LOGGED} SELECT * FROM logged")
def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of every head of the store, by doubling."""
    commits = stash(store.store(spark, sf_dir).commits("parents_subject"), "commits")
    return reports.log(commits, _store_heads(commits)).select("head", "depth", "oid", "line")


@query(f"{_S}, {_LOGGED} SELECT * FROM logged WHERE depth < 3")
def store_log_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three commits of every head (the limit is the feature); no other commit is read."""
    db = store.store(spark, sf_dir)
    subject = B.commit_field(F.col("payload"), "subject")
    heads = _store_heads(stash(db.commits("parents"), "commits"))
    return db.history(heads, 3).select("head", "depth", "oid", F.concat_ws(" ", "oid", subject).alias("line"))


@query(f"{_S} SELECT DISTINCT t.tree AS root, u.blob AS oid, 'turns/turn-' || lpad(CAST(u.turn AS VARCHAR), 4, '0') || '.txt' AS path FROM turns t JOIN turns u ON u.conv_id = t.conv_id AND u.turn <= t.turn UNION ALL SELECT DISTINCT tree, blob, 'latest' FROM turns")
def store_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blobs of every commit's tree, by path."""
    db = store.store(spark, sf_dir)
    return graph.descend(db.tree_entries, db.commits("tree_parents").select(F.col("tree").alias("root")).distinct())


@query(f"{_S} SELECT oid, store, true AS id_holds, true AS crc_holds FROM once")
def store_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each object's id is that of its bytes, and the checksum in its index, if it has any, that of the pack's."""
    return store.store(spark, sf_dir).verify().select("oid", "store", "id_holds", F.coalesce("crc_holds", F.lit(True)).alias("crc_holds"))
