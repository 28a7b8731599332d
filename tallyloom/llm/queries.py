"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import chat, oracles
from tallyloom.llm.ann import nearest
from tallyloom.llm.classifier import score_quality
from tallyloom.llm.licenses import scan_licenses
from tallyloom.llm.mixing import mix_sources
from tallyloom.llm.neardup import near_duplicates
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.passages import repeated_passages
from tallyloom.llm.phrases import collocations
from tallyloom.llm.quality import quality_rules
from tallyloom.llm.runs import periodic_runs
from tallyloom.llm.secrets import BASE, scan_secrets
from tallyloom.llm.staging import staged
from tallyloom.llm.textcols import GAP, let
from tallyloom.llm.tokencounts import count_tokens, new_rollup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, score and verdict of every document."""
    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base counts, the digest of the base spans, all spans, and links (starts of secret,
    identifier and endpoint)."""
    seen = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("secret_spans", lambda s: s["kind"].isin([k[0] for k in BASE]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    start = lambda x: F.coalesce(x["start"].cast("string"), F.lit(""))
    linked = lambda m: F.concat_ws(">", start(m["secret"]), start(m["identifier"]), start(m["endpoint"]))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return seen.select(
        "doc_id",
        *[count(k[0]).alias(f"n_{k[0]}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"),
        F.array_join(F.transform("secret_links", linked), ",").alias("links"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, read back: turns, loss mask and length."""
    conflict = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", conflict), (-7, 1, "assistant", conflict)], rows.schema)
    made = chat.format_chats(rows.unionByName(own)).withColumn("turns", chat.parse(F.col("formatted")))
    made = made.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates found in every document, with the place of the best window."""
    seen = scan_licenses(_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("licenses", lambda m: F.concat_ws("@", m["license"], m["start"])), ",")
    least = F.array_min(F.transform("licenses", lambda m: m["containment"]))
    return seen.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), listed.alias("licenses"), F.round(least, 6).alias("least_containment"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, two of them committed twice.

    Estimates by length come first, exact counts beside them under their own version, then the end token revises the
    exact counts, and at last documents without tokens are deleted from both.
    """
    docs = _table(spark, sf_dir, "documents")
    exact = count_tokens(docs).withColumn("version", F.lit("word_bpe_49k"))
    length = F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).cast("long")
    estimates = docs.select("doc_id", "source", "lang", length.alias("tokens"), F.lit("chars_4").alias("version"))
    counts = staged(exact.unionByName(estimates), "token-counts")

    def change(rows: DataFrame, kind: str, tokens: str = "tokens", old: str = "0") -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "source", "lang", "version", F.expr(tokens).alias("tokens"), F.expr(old).cast("long").alias("old_tokens"))

    rough, fine = counts.filter("version = 'chars_4'"), counts.filter("version = 'word_bpe_49k'")
    rollup = new_rollup(spark)
    batches = [
        ("1-estimates", change(rough, "insert")),
        ("2-exact", change(fine, "insert")),
        ("3-end-token", change(fine, "revise", "tokens + 1", "tokens")),
        ("4-empty", change(rough.filter("tokens = 0"), "delete").union(change(fine.filter("tokens = 0"), "delete", "tokens + 1"))),
    ]
    for batch, changes in [*batches, batches[1], batches[2]]:
        rollup.commit(batch, changes)
    return rollup.totals()


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.85 or more on three-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 4096 tokens."""
    pieces = pack_documents(_table(spark, sf_dir, "documents"), memory=1.73)  # packing alone leaves an executor room for more words
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "example_id")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every query."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words or more that an earlier document holds too."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of four in five ids."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learned=~held_out)
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


def _planted_repeats() -> Column:
    """The text; of every tenth document by the checksum of its id, with its last words repeating a stretch of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        word = lambda i: F.get(words, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " "))

    words = F.filter(F.split("text", GAP), lambda w: w != "")
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(F.col("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in every document (of every tenth with repeats planted): number, longest, digest of all, digest of the rest."""
    found = periodic_runs(_table(spark, sf_dir, "documents").withColumn("text", _planted_repeats()))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"], r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by how tightly their parts bind."""
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_source_mix": op5_source_mix,
    "op6_token_rollup": op6_token_rollup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_packing": op8_packing,
    "op9_nearest": op9_nearest,
    "op10_passages": op10_passages,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_collocations": op13_phrase_collocations,
}
ORACLES = {
    "op2_secret_scan": oracles.OP2,
    "op3_chat_format": oracles.OP3,
    "op4_license_scan": oracles.OP4,
    "op5_source_mix": oracles.OP5,
    "op13_phrase_collocations": oracles.OP13,
}
