"""The queries of the corpus operators over the test tables: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depquarry.llm import bpe, chat, chatrepair, expiring, ngramlm, sitetree, tokenbin, toxicity, warc, winnow
from depquarry.llm.common import shared_path, table, written
from depquarry.llm.decontam import decontaminate
from depquarry.llm.minhash import NearDup, near_duplicates
from depquarry.llm.projections import near_embeddings


def tokenizer_file(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write_warc(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return warc.read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(shingle_words=2))


def op3_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("word_bpe_49k.json")
    both = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(table(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast(c.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(c.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_chats(c.unionByName(more)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenbin.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return tokenbin.read_token_files(tokenbin.file_starts(written(files, "token-files")), with_ids=False)


#: Two tokens of context, with two steps of back-off.
LM_ORDER = 3


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = ngramlm.tokenized(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return ngramlm.score(tokens, LM_ORDER)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return chatrepair.digest(rows, *chatrepair.repair(chatrepair.damage(rows)))


#: Batches that the copies of clicks are cut into.
CLICK_BATCHES = 10


def op13_expiring_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expiring.deduplicate(expiring.click_copies(table(spark, sf_dir, "clicks"), CLICK_BATCHES), CLICK_BATCHES)


QUERIES = {
    f.__name__: f
    for f in (op1_warc_round_trip, op2_minhash_near_dedup, op3_winnowing_fingerprints, op4_bpe_encode_decode, op5_html_main_text, op6_chat_format, op7_token_files, op8_backoff_lm, op9_toxicity, op10_decontamination, op11_embedding_near_dedup, op12_conversation_repair, op13_expiring_clicks)
}
