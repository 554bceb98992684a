"""The operators of this folder as queries over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import byte_bpe, language_id, merkle, page_text, secrets, toxicity
from larder.llm.archives import page_archive
from larder.llm.decontaminate import decontaminate
from larder.llm.exact_duplicates import exact_duplicates
from larder.llm.near_duplicates import near_duplicates
from larder.llm.prefix_trie import ordered_turns, prefix_trie
from larder.llm.quotations import link_quotations
from larder.llm.shared import remainder, stored, table
from larder.llm.top_k import quantised, top_k, whole
from larder.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def byte_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that cuts texts into words."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = byte_vocabulary()
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = byte_bpe.encode(docs, ranks=ranks, pattern=pattern, decoded="decoded")
    # The text form of an array is its numbers between brackets, with a comma and a space between them.
    spaced = F.replace(F.btrim(F.col("ids").cast("string"), F.lit("[]")), F.lit(","), F.lit(""))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(spaced, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_page_text")
def op2_page_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return page_text.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "least_certain"
    )


@query("op3_archives")
def op3_archives(spark: SparkSession, folder: str) -> DataFrame:
    return page_archive(table(spark, folder, "pages"), scratch_path(spark, "archives"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.train(docs.where(~language_id.fold() & F.col("doc_id").isNotNull()))
    rows = docs.select("doc_id", language_id.fold().alias("held_out"), "text")
    return language_id.predict(rows, model).drop("text")


LINES = "string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
LEVEL = r"length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g'))"


@query(
    "op5_quotations",
    rf"""
    WITH RECURSIVE marked AS (
        SELECT *, {LEVEL} AS level FROM (SELECT conv_id, turn, unnest({LINES}) AS line FROM conversations)
    ), printed AS (
        SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(
            CASE WHEN level = 0 THEN line ELSE regexp_replace(line, '^((?:[ \t]*>)*)[ \t]?', '') END), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS print
        FROM marked
    ), sources AS (
        SELECT q.conv_id, q.turn, q.print, max(o.turn) AS source FROM printed q
        JOIN printed o ON o.conv_id = q.conv_id AND o.print = q.print AND o.turn < q.turn
        WHERE q.level = 1 AND o.level = 0 AND q.print <> '' GROUP BY ALL
    ), votes AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, source DESC) AS k
        FROM (SELECT conv_id, turn, source, count(*) AS n FROM sources GROUP BY ALL)
    ), replies AS (SELECT conv_id, turn, source AS reply_to FROM votes WHERE k = 1),
    chain AS (
        SELECT conv_id, turn, reply_to, reply_to AS thread, 1 AS depth FROM replies
        UNION ALL
        SELECT c.conv_id, c.turn, c.reply_to, r.reply_to, c.depth + 1
        FROM chain c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.thread
    ), ends AS (
        SELECT conv_id, turn, max(reply_to) AS reply_to, arg_max(thread, depth) AS thread, max(depth) AS depth FROM chain GROUP BY ALL
    )
    SELECT m.conv_id, m.turn, role,
           trim(regexp_replace(array_to_string([x FOR x IN {LINES} IF NOT regexp_matches(x, '^[ \t]*>')], chr(10)),
                               '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text,
           CAST(len([x FOR x IN {LINES} IF {LEVEL.replace("line", "x")} = 1]) AS INTEGER) AS quoted,
           reply_to, coalesce(thread, m.turn) AS thread, CAST(coalesce(depth, 0) AS INTEGER) AS depth, coalesce(position, 0) AS position
    FROM conversations m
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position FROM ends) e ON e.conv_id = m.conv_id AND e.turn = m.turn
    """,
)
def op5_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return link_quotations(table(spark, folder, "conversations"))


# Lower-cases A-Z only.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_near_duplicates",
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : CASE WHEN len(w) < 3 THEN len(w) ELSE i + 2 END], ' ') AS shingle
        FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
    ), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON b.shingle = a.shingle AND b.doc_id <> a.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
    ), reach AS (
        SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node
    ), roots AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN roots USING (doc_id)
    """,
)
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(~toxicity.fold())
    rows = docs.select("doc_id", toxicity.fold().alias("held_out"), "text")
    return toxicity.score(rows, toxicity.train(docs, labels)).drop("text")


ALNUM_WORDS = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op8_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents), b AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
    ), sizes AS (SELECT DISTINCT k FROM windows),
    found AS (
        SELECT o.doc_id, o.i, o.k, v.item_id
        FROM (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
              FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)) o
        JOIN windows v ON v.k = o.k AND v.g = o.g
    ), hits AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names
        FROM found GROUP BY doc_id
    )
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op9_top_k",
    """
    WITH v AS (
        SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q, v c
        WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(whole(F.col("embedding")))
    rows = rows.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return top_k(rows.where("vec_id % 20 = 0"), rows, k=20)


@query("op10_secrets")
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@query(
    "op11_exact_duplicates",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
    SELECT doc_id, keep_id, group_size, CASE WHEN keep_id IS NULL THEN true ELSE coalesce(doc_id = keep_id, false) END AS kept,
           sha256(d.text) AS text_sha256
    FROM d JOIN g ON g.text = d.text
    """,
)
def op11_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


# crc32 of the decimal id, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST({0} AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                             lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
        FROM (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
                     CASE WHEN doc_id IS NOT NULL AND {CRC32.format("doc_id")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")}
                          ELSE {_leaf_sql("n_chars")} END AS presented
              FROM documents)
    ), low AS (
        SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM d GROUP BY lang
        UNION ALL
        SELECT lang, level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]
        FROM low WHERE len(nodes) > 1
    ), subroots AS (
        SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM low WHERE len(nodes) = 1
    ), high AS (
        SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
        UNION ALL
        SELECT level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]
        FROM high WHERE len(nodes) > 1
    ), lows AS (SELECT lang, list(nodes ORDER BY level) AS tree_nodes FROM low WHERE len(nodes) > 1 GROUP BY lang),
    highs AS (SELECT list(nodes ORDER BY level) AS top_nodes FROM high WHERE len(nodes) > 1),
    paths AS (
        SELECT d.doc_id, leaf, presented, subroot,
               list_concat([CASE WHEN (pos >> k) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(tree_nodes[k + 1][xor(pos >> k, 1) + 1], '')
                            FOR k IN range(coalesce(len(tree_nodes), 0))],
                           [CASE WHEN (tree >> k) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(top_nodes[k + 1][xor(tree >> k, 1) + 1], '')
                            FOR k IN range(coalesce(len(top_nodes), 0))]) AS steps
        FROM d JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang
        LEFT JOIN lows l ON l.lang IS NOT DISTINCT FROM d.lang CROSS JOIN highs
    ), folded AS (
        SELECT *, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
               list_reduce(list_prepend(presented, steps),
                           lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
        FROM paths
    )
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] FOR s IN steps], '')) AS proof_sha256, folded_root,
           folded_root = root AS verified
    FROM folded
    """,
)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def leaf(n_chars: Column) -> Column:
        return merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))

    changed = F.coalesce(remainder("doc_id", 7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(changed, leaf(more)).alias("other"))
    rows = rows.withColumn("presented", F.coalesce("other", "leaf"))
    found = merkle.manifest(rows, key="doc_id", group="lang", digest="leaf", presented="presented")
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified"
    )


@query(
    "op13_prefix_trie",
    f"""
    WITH t AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, conv_id - conv_id % 100 AS source, n, {CRC32.format("conv_id")} % 6 AS h
        FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
    ), x AS (
        SELECT c.*, least(c.h, coalesce(s.n, 0)) AS head, least(c.h, coalesce(s.n, 0)) + greatest(c.n - c.h, 0) AS length
        FROM c LEFT JOIN c s ON s.conv_id = c.source
    ), r AS (
        SELECT x.conv_id, pos + 1 AS depth, role, text FROM x JOIN t ON t.conv_id = x.source AND t.pos < x.h
        UNION ALL
        SELECT x.conv_id, head + pos - h + 1, role, text FROM x JOIN t ON t.conv_id = x.conv_id AND t.pos >= x.h
    ), p AS (
        SELECT conv_id, depth, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, length(text) AS size
        FROM r
        UNION ALL SELECT conv_id, 0, [], 0 FROM x
    ), g AS (SELECT prefix, depth, min(conv_id) AS name, count(*) AS n_convs, min(size) AS size FROM p GROUP BY prefix, depth),
    n AS (
        SELECT g.*, u.name AS parent FROM g LEFT JOIN p q ON q.conv_id = g.name AND q.depth = g.depth - 1
        LEFT JOIN g u ON u.prefix = q.prefix
    ), k AS (SELECT parent AS name, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    m AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.name = n.name AND k.depth = n.depth
    ), sums AS (
        SELECT a.prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * m.size) AS saved
        FROM m JOIN p a ON a.conv_id = m.name AND a.depth <= m.depth GROUP BY a.prefix
    ), ends AS (
        SELECT prefix, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS names
        FROM p JOIN x ON x.conv_id = p.conv_id AND x.length = p.depth GROUP BY prefix
    )
    SELECT m.name AS conv_id, m.depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(names, '')) AS ends_sha256
    FROM m JOIN sums ON sums.prefix = m.prefix LEFT JOIN ends ON ends.prefix = m.prefix
    """,
)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, members = shared_heads(stored(ordered_turns(table(spark, folder, "conversations"))))
    return prefix_trie(turns, members)


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % 100 in place of its own; h is crc32(c) % 6."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"h": remainder("conv_id", 6), "source": F.col("conv_id") - F.col("conv_id") % 100}
    )
    sizes = convs.select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    convs = stored(convs.join(sizes, "source", "left").withColumn("head", F.least("h", F.coalesce("source_n", F.lit(0)))))
    heads = turns.where("position < 5").withColumnRenamed("conv_id", "source").join(convs.select("conv_id", "source", "h"), "source")
    heads = heads.where("position < h").select("conv_id", (F.col("position") + 1).alias("depth"), "print", "size")
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("position >= h")
    own = own.select("conv_id", (F.col("head") + F.col("position") - F.col("h") + 1).alias("depth"), "print", "size")
    return heads.unionByName(own), convs.select("conv_id")
