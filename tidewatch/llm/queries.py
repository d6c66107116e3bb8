"""One query per operator over its whole table, with a SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat,
    decontaminate,
    exact_dedup,
    harmonic,
    language_id,
    line_templates,
    lm_score,
    merkle,
    packing,
    queries_sql,
    repair,
    secret_scan,
    simhash,
    token_store,
)
from tidewatch.llm.base import documents, in_fold
from tidewatch.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = in_fold(F.col("doc_id"), lm_score.FOLDS, lm_score.HELD_OUT_FOLD)
    model = lm_score.fit(docs, held=held)
    found = lm_score.score_coded(model.coded, model)
    return found.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query("op2_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_id.learn_profiles(language_id.training_part(docs))
    held = in_fold(F.col("doc_id"), language_id.FOLDS, language_id.HELD_OUT_FOLD)
    found = language_id.predict(docs, profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op3_line_templates", queries_sql.LINES)
def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.line_report(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query("op4_decontamination", queries_sql.CONTAMINATION)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op5_secret_scan")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(
                    ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        of(secret_scan.LEARNED).alias("n_learned"),
    )


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op7_token_binary_output")
def token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, added_tokens=True)
    return token_store.read_store(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op8_chat_formatting", queries_sql.CHAT)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string",
    )
    found = chat.read_back(chat.windows(rows.union(added)))
    return found.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op9_exact_dedup", queries_sql.EXACT)
def exact_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op10_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), added_tokens=True)


@query("op12_conversation_repair", queries_sql.REPAIR)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.Repair(repair.damage(documents(spark, sf_dir, "conversations"))).report()


@query("op13_harmonic_packing")
def harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return harmonic.pack_harmonic(docs, added_tokens=True, with_ids=False).drop("ids")


@query("op11_merkle_manifest", queries_sql.MERKLE)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.checked(merkle.manifest(docs, changed=changed))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        "verified",
    )
