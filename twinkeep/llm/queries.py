"""The operators as named queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.llm import chat, extraction, hardneg, langid, merkle, mixing, occurrence, pii, quality, search, simhash, toxicity, winnowing
from twinkeep.llm.rows import fold_of, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(make: Callable[[SparkSession, str], DataFrame]):
    QUERIES[make.__name__] = make
    return make


@query
def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return winnowing.digest(winnowing.contamination(docs, items))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold_of("doc_id", 5) == 0)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.train(docs.where("NOT held_out").join(labels, "doc_id"))
    found = toxicity.score(docs.select("doc_id", "held_out", "text"), lexicon)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold_of("doc_id", 4) == 2)
    model = langid.train(docs.where("NOT held_out"))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


@query
def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(mixing.annotate(docs)).drop("text")


#: Score from which a text counts as good.
GOOD = 0.7


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Neighbours:
    """Learned from the rows of ``docs`` that have a label and are not held out."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    learned = docs.select("doc_id", "text").where(fold_of("doc_id", 4) != 2)
    return quality.train(learned.join(labels, "doc_id"))


@query
def op7_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = quality.score(docs.select("doc_id", "text"), quality_model(docs, spark, sf_dir))
    return found.select(
        "doc_id",
        (fold_of("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )


@query
def op8_blockmax_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = docs.where("doc_id % 50 = 0")
    return search.search(search.index(docs), asked, "doc_id")


@query
def op9_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extraction.extract(pages, extraction.train(pages))
    return found.select("page_id", "url", "text", "n_chars")


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_pii(docs))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = merkle.leaf_of("doc_id", "source", "lang", "n_chars", F.translate("text", _UPPER, _LOWER))
    own = merkle.leaf_of("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select("doc_id", "lang", own.alias("leaf"), F.when(changed, tampered).otherwise(own).alias("checked"))
    return merkle.digest(merkle.verify(merkle.prove(leaves, carry=["checked"]), "checked"))


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrence.join(read_table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", moved))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_winnowing": OP1_SQL,
        "op4_chat_snapshots": OP4_SQL,
        "op8_blockmax_search": OP8_SQL,
        "op11_merkle": op11_sql(),
        "op12_jaccard_join": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }


#: Words by pattern, windows by a word join on the window's text.
OP1_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM item WHERE len(w) > 0)),
place AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, s, place.n, item_id FROM place JOIN win USING (n, t)),
words AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
own AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN own USING (r)
"""

#: Conversations as lists of turns; prefixes are compared as lists.
OP4_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l
  FROM turns GROUP BY conv_id),
pre AS (SELECT conv_id, n_turns, l[1:k] AS p FROM (SELECT *, unnest(range(1, n_turns)) AS k FROM conv)),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, l FROM conv
  WHERE l NOT IN (SELECT p FROM pre) GROUP BY n_turns, l)
SELECT conv_id, 0 AS part, n_turns,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x.r, 'unknown') || chr(10)
                       || coalesce(x.t, '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM kept
"""

#: Every document scored for every query that shares a term with it.
OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(len(w)) / CAST(count(*) AS DOUBLE) AS mean FROM doc),
tf AS (SELECT r, t, CAST(count(*) AS DOUBLE) AS f FROM (SELECT r, unnest(w) AS t FROM doc) GROUP BY r, t),
df AS (SELECT t, count(*) AS d FROM tf GROUP BY t),
idf AS (SELECT t, ln(1 + (n - d + 0.5) / (d + 0.5)) AS i FROM df, s),
asked AS (
  SELECT r AS q, t, i FROM tf JOIN idf USING (t) JOIN doc USING (r) WHERE doc_id % 50 = 0),
scored AS (
  SELECT q, r, sum(CAST(floor(i * (f * (1.2 + 1) / (f + 1.2 * (1 - 0.75 + 0.75 * len(w) / mean))) * 1048576 + 0.5) AS BIGINT)) AS total
  FROM asked JOIN tf USING (t) JOIN doc USING (r), s GROUP BY q, r)
SELECT a.doc_id AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY total DESC, b.doc_id NULLS LAST) AS INTEGER) AS rank,
       b.doc_id AS doc_id, total / CAST(1048576 AS DOUBLE) AS score
FROM scored JOIN doc a ON a.r = q JOIN doc b ON b.r = scored.r
QUALIFY rank <= 10
"""

#: Sets joined by shingle, classes by reachability.
OP12_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
link AS (
  SELECT a, b FROM (
    SELECT x.r AS a, y.r AS b, count(*) AS c FROM shingle x JOIN shingle y USING (s) WHERE x.r <> y.r GROUP BY x.r, y.r)
  JOIN size na ON na.r = a JOIN size nb ON nb.r = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT r, r AS o FROM doc UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.o),
component AS (SELECT reach.r, min(doc.doc_id) AS component_id FROM reach JOIN doc ON doc.r = reach.o GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       CAST((SELECT count(*) FROM link WHERE a = doc.r) AS BIGINT) AS n_links
FROM doc LEFT JOIN size USING (r) LEFT JOIN component USING (r)
"""

#: Every anchor against every row.
OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS b, b.vec_id AS id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
positive AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST, n.b) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.a = p.a AND NOT n.same
WHERE 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


def op11_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** ``levels`` leaves, a query per level; crc32 bit by bit over the digits of an id."""

    def part(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    crc = (
        "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        " lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: "
        "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:"
        " CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    parts = [
        f"""doc AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
         CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS checked
  FROM documents)""",
        """own AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM doc)""",
    ]

    def tree(name: str, zero: str) -> None:
        parts.append(f"{name}0 AS ({zero})")
        for k in range(levels):
            parts.append(f"""{name}run{k} AS (
  SELECT t, pos // 8 AS up, any_value(n) AS n, list(h ORDER BY pos) AS l FROM {name}{k} WHERE n > 1 GROUP BY t, pos // 8)""")
            parts.append(f"""{name}{k + 1} AS (
  SELECT t, up AS pos, (n + 7) // 8 AS n, sha256(array_to_string(l, '')) AS h FROM {name}run{k}
  UNION ALL SELECT * FROM {name}{k} WHERE n = 1)""")

    tree("a", "SELECT coalesce('=' || lang, '') AS t, pos, n, leaf AS h FROM own")
    tree("b", f"SELECT 0 AS t, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n, h FROM a{levels}")
    parts.append("number AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS b FROM (SELECT DISTINCT t FROM a0))")
    last = "f0"
    parts.append("""f0 AS (
  SELECT doc_id, leaf, checked, coalesce('=' || lang, '') AS t, pos, b AS top, '' AS proof, checked AS h
  FROM own JOIN number ON number.t = coalesce('=' || lang, ''))""")
    at = 0
    for name, pos, on in (("a", "pos", "r.t = f.t AND r.up = f.pos // 8"), ("b", "top", "r.up = f.top // 8")):
        for k in range(levels):
            others = f"array_to_string(list_concat(l[1 : f.{pos} % 8], l[f.{pos} % 8 + 2 : 8]), '')"
            with_own = f"array_to_string(list_concat(l[1 : f.{pos} % 8], [f.h], l[f.{pos} % 8 + 2 : 8]), '')"
            at += 1
            parts.append(f"""f{at} AS (
  SELECT doc_id, leaf, checked, f.t, {"f.pos // 8 AS pos, top" if pos == "pos" else "f.pos, top // 8 AS top"},
         CASE WHEN l IS NULL THEN proof ELSE proof || {others} END AS proof,
         CASE WHEN l IS NULL THEN f.h ELSE sha256({with_own}) END AS h
  FROM {last} f LEFT JOIN {name}run{k} r ON {on})""")
            last = f"f{at}"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, a{levels}.h AS subroot, b{levels}.h AS root, sha256(proof) AS proof_sha256,
       f.h AS folded_root, f.h = b{levels}.h AS verified
FROM {last} f JOIN a{levels} USING (t), b{levels}"""
    )
