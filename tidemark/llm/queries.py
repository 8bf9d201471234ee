"""Queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path
from . import exact_dedup, extract, language, licences, manifest, minhash, mixing, neighbours, packing, preference, quality, variants, warc
from .common import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text."""
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


CHECKS["op2_exact_dedup"] = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER w = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)"""


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


CHECKS["op6_mixing"] = r"""
    WITH RECURSIVE d AS MATERIALIZED (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
               md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
        FROM documents),
    s AS MATERIALIZED (
        SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
    rounds AS (
        SELECT 0 AS k, source, source_size, weight, false AS clamped, NULL::DOUBLE AS level, true AS more FROM s
        UNION ALL
        SELECT k + 1, source, source_size, weight, clamped OR over, level, max(over) OVER () FROM (
            SELECT k, source, source_size, weight, clamped, lvl AS level, NOT clamped AND lvl * weight > 3 * source_size AS over FROM (
                SELECT *, CAST(sum(source_size) OVER () - sum(CASE WHEN clamped THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE)
                          / sum(CASE WHEN NOT clamped THEN weight END) OVER () AS lvl FROM rounds WHERE more))),
    goals AS MATERIALIZED (
        SELECT source, source_size, target, whole, target - whole * source_size AS goal FROM (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), 3) END AS whole FROM (
                SELECT *, CASE WHEN clamped THEN CAST(3 * source_size AS DOUBLE) ELSE level * weight END AS target
                FROM rounds WHERE k = (SELECT max(k) FROM rounds)))),
    c AS MATERIALIZED (
        SELECT d.*, g.source_size, g.target, g.whole, g.goal,
               sum(size) OVER (PARTITION BY d.source ORDER BY h) AS reached
        FROM d JOIN goals g ON g.source IS NOT DISTINCT FROM d.source),
    e0 AS MATERIALIZED (SELECT *, reached <= goal AS x, goal - coalesce(max(CASE WHEN reached <= goal THEN reached END) OVER (PARTITION BY source), 0) AS gap FROM c),
    e1 AS MATERIALIZED (SELECT * REPLACE (x OR p AS x, gap - coalesce(max(CASE WHEN p THEN size END) OVER (PARTITION BY source), 0) AS gap) FROM (
        SELECT *, NOT x AND size > 0 AND size <= gap AND row_number() OVER (PARTITION BY source, NOT x AND size > 0 AND size <= gap ORDER BY size DESC, h DESC) = 1 AS p FROM e0)),
    e2 AS MATERIALIZED (SELECT * REPLACE (x OR q AS x, gap - coalesce(max(CASE WHEN q THEN size END) OVER (PARTITION BY source), 0) AS gap) FROM (
        SELECT *, NOT x AND size > 0 AND size <= gap AND row_number() OVER (PARTITION BY source, NOT x AND size > 0 AND size <= gap ORDER BY size DESC, h DESC) = 1 AS q FROM e1)),
    e3 AS MATERIALIZED (SELECT *, x OR (NOT x AND size > 0 AND size <= gap AND
            row_number() OVER (PARTITION BY source, NOT x AND size > 0 AND size <= gap ORDER BY size DESC, h DESC) = 1) AS y FROM e2)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN y THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e3"""


def tokenizer_files() -> dict[str, str]:
    """Where this installation keeps its public byte-level vocabulary."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken")}


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), **tokenizer_files())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    samples = language.fit(docs, ~language.held_out())
    return language.predict(docs.select("doc_id", language.held_out().alias("held_out"), "text"), samples).drop("text")


@query
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


@query
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


CHECKS["op5_neighbours"] = """
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_reduce(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
          FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.r <> q.r AND len(q.e) = len(v.e))
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


@query
def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, paired, as prompts and masked completions."""
    rows = stored(preference.turns(table(spark, sf_dir, "conversations")), "preference-rows")
    return preference.formatted(rows, stored(preference.paired(rows), "preference-pairs"))


CHECKS["op4_preference"] = """
    WITH t AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS nth FROM (
            SELECT DISTINCT conv_id, coalesce(turn, 4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL)),
    heads AS (
        SELECT conv_id, first(text ORDER BY turn, nth) AS text, first(role ORDER BY turn, nth) AS role,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said
        FROM t GROUP BY conv_id),
    placed AS (SELECT *, row_number() OVER (ORDER BY text, role, conv_id) - 1 AS place FROM heads),
    pairs AS MATERIALIZED (
        SELECT place // 2 AS pair_id, first(conv_id ORDER BY said DESC, place) AS chosen_id,
               CASE WHEN count(*) > 1 THEN last(conv_id ORDER BY said DESC, place) END AS rejected_id
        FROM placed GROUP BY place // 2),
    b AS MATERIALIZED (
        SELECT p.*, s.side, t.turn, t.nth, t.role, t.text
        FROM pairs p, (VALUES ('chosen'), ('rejected')) s(side)
             JOIN t ON t.conv_id = CASE s.side WHEN 'chosen' THEN p.chosen_id ELSE p.rejected_id END),
    cut AS (
        SELECT pair_id, min((turn, nth)) AS cut FROM (
            SELECT pair_id, turn, nth FROM b GROUP BY pair_id, turn, nth, role, text HAVING count(*) = 1) GROUP BY pair_id)
    SELECT b.pair_id, chosen_id, rejected_id, CASE WHEN common THEN 'prompt' ELSE side END AS side, turn, CAST(nth AS INTEGER) AS nth, role,
           '<|' || role || '|>' || chr(10) || text || chr(10) AS segment, NOT common AND role = 'assistant' AS loss
    FROM (SELECT b.*, c.cut IS NULL OR (turn, nth) < c.cut AS common FROM b LEFT JOIN cut c ON c.pair_id = b.pair_id) b
    WHERE NOT common OR side = 'chosen'"""


@query
def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences every document states."""
    return licences.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def _licence_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = licences.known()
    body = "coalesce(text, '')"
    for pattern, put in licences.BEFORE:
        body = f"regexp_replace({body}, {quoted(pattern)}, {quoted(put.replace('$1', chr(92) + '1'))}, 'g')"
    listed = ", ".join(map(quoted, known))
    table = "MAP {" + ", ".join(f"{quoted(k)}: {v}" for k, v in known.items()) + "}"

    def identifiers(text: str, end: str) -> str:
        norm = f"list_transform(string_split_regex({text}, {quoted(end)}), lambda s: trim(regexp_replace(lower(s), {quoted(licences.OTHER)}, ' ', 'g')))"
        return f"list_transform(list_filter({norm}, lambda s: s IN ({listed})), lambda s: {table}[s])"

    text = lambda ids: f"',' || coalesce(array_to_string({ids}, ','), '') || ','"
    met = lambda n: "(" + " OR ".join(f"regexp_matches({c}, {quoted(licences.rule_pattern(r))})" for r in licences.RULES[n] for c in "xy") + ")"
    each = [f"CASE WHEN {met(n)}" + (f" AND NOT {met(licences.WITHIN[n])}" if n in licences.WITHIN else "") + f" THEN {quoted(n)} END" for n in sorted(licences.RULES)]
    return f"""
    SELECT doc_id, array_to_string(list_filter([{", ".join(each)}], lambda l: l IS NOT NULL), ',') AS licences,
           CAST(greatest(len(a), len(b)) AS INTEGER) AS sentences
    FROM (SELECT *, {text("a")} AS x, {text("b")} AS y FROM (
        SELECT doc_id, {identifiers(f"regexp_replace(t, {quoted(licences.LINES)}, ' ', 'g')", licences.FLOWING)} AS a,
               {identifiers("t", licences.BY_LINE)} AS b
        FROM (SELECT doc_id, {body} AS t FROM documents)))"""


CHECKS["op9_licences"] = _licence_sql()


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, roots and proof, checked after line ends were taken from half of the texts."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit("")))
    found = manifest.manifest(table(spark, sf_dir, "documents"), list(manifest.FIELDS), "doc_id", "source", tampered, "text")
    return found.withColumnRenamed("key", "doc_id")


def _crc32_sql(codes: str) -> str:
    """CRC-32 of a list of byte values: eight shifts a byte."""
    bits = f"flatten(list_transform({codes}, lambda b: [CAST(b AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    shift = "xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))"
    return f"xor(list_reduce({bits}, lambda a, e: {shift}, CAST(4294967295 AS UBIGINT)), 4294967295)"


def _manifest_sql() -> str:
    def enc(column: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(enc(text if c == 'text' else c) for c in manifest.FIELDS)})"

    even = f"{_crc32_sql('list_transform(string_split(CAST(doc_id AS VARCHAR), chr(0)), lambda s: ord(s))').replace('chr(0)', chr(39) * 2)} % 2 = 0"
    # A level above a run of a tree of n nodes, for all trees at once; the tree of roots is the one numbered -1.
    return f"""
    WITH RECURSIVE d AS MATERIALIZED (
        SELECT doc_id, {leaf('text')} AS leaf, CASE WHEN {even} AND text IS NOT NULL THEN {leaf("replace(text, chr(10), '')")} END AS changed,
               dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS place
        FROM documents),
    low AS (
        SELECT tree, 0 AS level, place, leaf AS digest, n FROM d
        UNION ALL
        SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY ALL),
    subroots AS MATERIALIZED (SELECT tree, digest FROM low WHERE n = 1),
    high AS (
        SELECT 0 AS level, tree AS place, digest, (SELECT count(*) FROM subroots) AS n FROM subroots
        UNION ALL
        SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY ALL),
    runs AS MATERIALIZED (
        SELECT tree, level, place // 3 AS parent, list(digest ORDER BY place) AS run FROM low WHERE n > 1 GROUP BY ALL
        UNION ALL
        SELECT -1, level, place // 3, list(digest ORDER BY place) FROM high WHERE n > 1 GROUP BY ALL),
    steps AS (
        SELECT row_number() OVER () AS r, doc_id, leaf, tree, place, tree AS walked, 0 AS level, coalesce(changed, leaf) AS folded, '' AS proof, false AS done FROM d
        UNION ALL
        SELECT r, doc_id, leaf, s.tree, CASE WHEN run IS NULL THEN s.tree ELSE place // 3 END, CASE WHEN run IS NULL THEN -1 ELSE walked END,
               CASE WHEN run IS NULL THEN 0 ELSE s.level + 1 END,
               CASE WHEN run IS NULL THEN folded
                    ELSE sha256(array_to_string(run[1 : place % 3] || [folded] || run[place % 3 + 2 :], '')) END,
               CASE WHEN run IS NULL THEN proof ELSE proof || array_to_string(run[1 : place % 3] || run[place % 3 + 2 :], '') END,
               run IS NULL AND walked = -1
        FROM steps s LEFT JOIN runs u ON u.tree = s.walked AND u.level = s.level AND u.parent = s.place // 3
        WHERE NOT done)
    SELECT s.doc_id, s.leaf, t.digest AS subroot, h.digest AS root, sha256(s.proof) AS proof_sha256, s.folded AS folded_root, s.folded = h.digest AS verified
    FROM steps s JOIN subroots t ON t.tree = s.tree, (SELECT digest FROM high WHERE n = 1) h WHERE s.done"""


CHECKS["op13_manifest"] = _manifest_sql()


@query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word with its usual form."""
    return variants.variants(table(spark, sf_dir, "documents"))


def _variants_sql() -> str:
    # The SQL's edit distance counts bytes: accented letters become characters of one byte that words don't hold.
    accented, plain = "".join(map(chr, range(0xC0, 0x100))), "".join(map(chr, range(0x21, 0x61))).replace("'", "''")
    codes = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, w, count(*) AS n FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
    hashed AS MATERIALIZED (SELECT w, n, CAST({_crc32_sql(codes)} AS BIGINT) AS h FROM runs),
    words AS MATERIALIZED (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
        WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    coded AS MATERIALIZED (SELECT *, length(word) AS l, translate(word, '{accented}', '{plain}') AS c FROM words),
    near AS MATERIALIZED (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM coded a JOIN coded b ON b.l = a.l AND levenshtein(a.c, b.c) = 1
        UNION ALL SELECT a.word, a.n, b.word, b.n FROM coded a JOIN coded b ON b.l = a.l + 1 AND levenshtein(a.c, b.c) = 1
        UNION ALL SELECT a.word, a.n, b.word, b.n FROM coded a JOIN coded b ON b.l = a.l - 1 AND levenshtein(a.c, b.c) = 1),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    formed AS MATERIALIZED (
        SELECT w.word, CASE WHEN other_n >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
        FROM words w LEFT JOIN best b USING (word)),
    walk AS (
        SELECT word, word AS root, form AS next FROM formed
        UNION ALL
        SELECT k.word, k.next, f.form FROM walk k JOIN formed f ON f.word = k.next)
    SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.next IS NULL"""


CHECKS["op12_variants"] = _variants_sql()


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back: responses with their payloads, of revisits the headers alone."""
    path = scratch_path(spark, "warc")
    warc.write(warc.page_records(table(spark, sf_dir, "pages")), path)
    kind = table(spark, sf_dir, "pages").schema["page_id"].dataType
    page = lambda c: warc.page_key(F.col(c)).cast(kind)
    told = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    whole = warc.read(spark, path, "record_id string, record_type string, payload binary", "record_type = 'response'")
    whole = whole.select("record_id", "record_type", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"))
    again = warc.read(spark, path, told, "record_type = 'revisit'")
    return whole.unionByName(again).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


CHECKS["op11_warc"] = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS last FROM p),
    r AS (SELECT *, payload_bytes >= 1000 AND page_id <> last AS again FROM q)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r"""
