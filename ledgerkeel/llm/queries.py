"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    archives,
    boilerplate,
    chat,
    decontaminate,
    fingerprints,
    jaccard,
    mixing,
    pieces,
    quality,
    ranking,
    resampling,
    sharding,
    toxicity,
)
from .common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_mix")
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_size(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("ident")
    )
    plan = mixing.draw_plan(written(docs, "op1"), size=F.col("doc.size"), ident=F.col("doc.ident"))
    return plan.select(
        "doc.doc_id",
        "doc.size",
        "source_size",
        "target",
        (F.col("doc.size") * F.size("draws")).alias("taken"),
        F.expr("transform(draws, d -> d.shard)").alias("shards"),
    )


def shard_rows(sharded: DataFrame, text_crc32, doc_id="doc.doc_id") -> DataFrame:
    return sharded.select(
        doc_id,
        "size",
        text_crc32.alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_shard")
def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.byte_size(F.col("text")).alias("bytes"),
        sharding.text_crc32(F.col("text")).alias("crc"),
    )
    return shard_rows(sharding.shard(docs, 40, size=F.col("doc.bytes")), F.col("doc.crc"))


_SHINGLE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query(
    "op8_jaccard_join",
    f"""WITH RECURSIVE w AS (SELECT doc_id, {_SHINGLE_WORDS} AS ws FROM documents),
    s AS (
      SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
    r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reached)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
)
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.classify(docs).select("doc_id", "n_shingles", "component_id")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "score")
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "overlap", "union")


_BREAKING = boilerplate.BREAKING.removeprefix("(?i)").replace("'", "''")
_HIDDEN = boilerplate.HIDDEN.removeprefix("(?is)")


@query(
    "op9_line_dedup",
    f"""WITH texts AS (
      SELECT page_id,
        lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
        regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', chr(10), 'gsi'),
          '{_BREAKING}', chr(10), 'gi'), '<[^>]*>', '', 'g') AS body
      FROM pages),
    split AS (
      SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)),
        lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda x: x != '') AS lines FROM texts),
    common AS (
      SELECT host, list(line) AS keys FROM (
        SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM split WHERE host != '')
        GROUP BY host, line)
      JOIN (SELECT host, count(*) AS pages FROM split GROUP BY host) USING (host)
      WHERE n > 1 AND pages >= {boilerplate.MIN_PAGES} AND n > pages * {boilerplate.RATIO}::DOUBLE GROUP BY host),
    done AS (
      SELECT page_id, lines, CASE WHEN keys IS NULL THEN lines
        ELSE list_filter(lines, lambda x: NOT list_contains(keys, x)) END AS kept
      FROM split LEFT JOIN common USING (host))
    SELECT page_id, CAST(len(lines) AS INT) AS n_lines, CAST(len(lines) - len(kept) AS INT) AS n_dropped,
      sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM done""",
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = boilerplate.drop_boilerplate(table(spark, sf_dir, "pages"))
    return done.select(
        "doc.page_id",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "score")
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


_CASE = r"\### Assistant: </turn> ok"


def conversation_events(turns: DataFrame) -> DataFrame:
    """The event log that leads to each turn: two deltas, after a dropped draft for every
    learned turn and an edit of every other third one. Rows equal in conversation and turn are
    messages of their own."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    one, two = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    draft = F.reverse(text)

    def event(seq: int, kind: str, value):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), value.alias("text"))

    streamed = [event(3, "delta", one), event(4, "delta", two)]
    plain = F.array(*streamed)
    regenerated = F.array(event(1, "delta", draft), event(2, "regenerate", F.lit("")), *streamed)
    edited = F.array(event(1, "delta", draft), event(2, "edit", one), event(4, "delta", two))
    log = F.when(F.col("role") == chat.LEARNED_ROLE, regenerated).when(F.col("turn") % 3 == 2, edited).otherwise(plain)
    rows = turns.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("message"), log.alias("log"))
    return rows.select(
        "conv_id", "message", F.col("turn").alias("place"), F.col("role"), F.explode("log").alias("e")
    ).select("conv_id", "message", "place", "role", "e.seq", "e.kind", "e.text")


def _escaped(text: str) -> str:
    """Code points of a text once a backslash has gone into each of its control strings."""
    return f"length({text}) + len(regexp_extract_all({text}, '</?\\\\*turn'))"


@query(
    "op6_chat",
    f"""WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', '{chat.LEARNED_ROLE}']), '{_CASE}'),
    e AS (SELECT *, replace(replace(role, '\\', '\\\\'), chr(10), '\\n') AS plain FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LEARNED_ROLE}'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = '{chat.LEARNED_ROLE}'), '')) AS loss_sha256,
      sum({len(chat.OPEN) + len(chat.CLOSE) + 1} + {_escaped("plain")} + {_escaped("text")})::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id""",
)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_CASE).alias("text"),
    )
    return chat.read_back(chat.render(chat.fold(conversation_events(turns.unionByName(case)))))


@query(
    "op7_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS hex FROM pages),
    d AS (
      SELECT page_id, strlen(html) AS bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST((5 * i) // 4 + 1 AS INT), 2) AS INT)
          >> CAST(3 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS digest FROM p)
    SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
      CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
    FROM d WINDOW w AS (PARTITION BY digest)""",
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.convert_pages(table(spark, sf_dir, "pages"))


@query("op4_fingerprint")
def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_pieces")
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back; the library's own results are the test."""
    vocabulary = pieces.load(pieces.model_path())
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return encoded.select(
        "doc.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(pieces.decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_TERM = _TERMS.format(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_WORD = _TERMS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@query(
    "op12_ranking",
    f"""WITH d AS (SELECT doc_id, {_TERM} AS terms FROM documents),
    c AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
    t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS holding FROM t GROUP BY term),
    q AS (SELECT item_id, unnest(list_distinct({_TERM})) AS term FROM benchmark),
    s AS (
      SELECT item_id, doc_id, sum(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * holding + 1)))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN df USING (term) JOIN t USING (term), c GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {ranking.TOP}""",
)
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item.item_id", "rank", "doc_id", "score")


def _crc32(feature: str) -> str:
    """CRC-32 of a text in SQL, bit by bit of its UTF-8 bytes, lowest bit first."""
    bits = f"encode({feature})::BIT::VARCHAR"
    fed = f"list_transform(range(8 * octet_length(encode({feature}))), lambda i: CAST(substr({bits}, i // 8 * 8 + 8 - i % 8, 1) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {fed}), lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1))), 4294967295)"


def _features(of: str) -> str:
    """Rows (doc_id, feature, n) of a table's words and pairs of neighbouring words."""
    return f"""SELECT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)),
      lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM {of}"""


@query(
    "op13_resampling",
    f"""WITH d AS (SELECT doc_id, {_WORD} AS words FROM documents),
    b AS (SELECT item_id AS doc_id, {_WORD} AS words FROM benchmark),
    df AS (SELECT doc_id, feature, count(*) AS n FROM ({_features("d")}) GROUP BY ALL),
    bf AS (SELECT feature, count(*) AS n FROM ({_features("b")}) GROUP BY ALL),
    f AS (SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT feature FROM df UNION SELECT feature FROM bf)),
    own AS (SELECT bucket, sum(n) AS s FROM df JOIN f USING (feature) GROUP BY bucket),
    aim AS (SELECT bucket, sum(n) AS t FROM bf JOIN f USING (feature) GROUP BY bucket),
    sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM df)::DOUBLE AS all_s, (SELECT coalesce(sum(n), 0) FROM bf)::DOUBLE AS all_t),
    g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
      FROM own LEFT JOIN aim USING (bucket), sums),
    w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
      FROM df JOIN f USING (feature) JOIN g USING (bucket) GROUP BY doc_id),
    scored AS (
      SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
        CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
        floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
      FROM d LEFT JOIN w USING (doc_id)),
    able AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS able
      FROM scored WHERE n_words >= {resampling.MIN_WORDS})
    SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
      CASE WHEN place <= able * {resampling.PERCENT} // 100 THEN place END AS rank
    FROM scored LEFT JOIN able USING (doc_id)""",
)
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = resampling.score(docs, table(spark, sf_dir, "benchmark"))
    narrow = scored.select(F.struct("doc.doc_id").alias("doc"), "n_words", "n_features", "weight", "score")
    return resampling.draw(narrow).select("doc.doc_id", "n_features", "weight", "score", "rank")
