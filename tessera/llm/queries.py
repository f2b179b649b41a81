"""The corpus queries op1 to op13: thin digests of the operators beside this module."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bit_slices, bpe, decontam, fm_index, main_text, run_index, simhash, topk, toxicity, trie_bpe, twins, url_templates, warc, word_variants
from .common import fresh_path, table


def op4_suffix_dedup(spark, sf_dir):
    left = run_index.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_topk(spark, sf_dir):
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_url_templates(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.folded(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


def op9_warc(spark, sf_dir):
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    back = warc.read_archives(spark, path, with_data=False).where("last")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark, sf_dir):
    found = decontam.with_verdict(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op1_substring_dedup(spark, sf_dir):
    left = fm_index.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


RANKS = "byte_bpe_multi_50k.tiktoken"


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    path = "file://" + public_tokenizers.path(RANKS)
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark, sf_dir):
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), size=3, bits=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


TOKENIZER = "byte_bpe_50k.json"


def op11_trie_bpe(spark, sf_dir):
    import public_tokenizers

    path = "file://" + public_tokenizers.path(TOKENIZER)
    coded = trie_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, packed=True, decoded="decoded")
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_word_variants(spark, sf_dir):
    found = word_variants.variants(table(spark, sf_dir, "documents"), slip=97)
    return found.select("word", "n", "n_near", "form", "form_n", "root")


def op13_bit_slices(spark, sf_dir):
    lines = table(spark, sf_dir, "sale_lines")
    whole = lambda c: F.floor(c + 0.5).cast("long")
    sale = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    part = F.coalesce((F.col("item_id") % 2).cast("long"), F.lit(-1))
    month = F.coalesce((100 * F.year("shipped_at") + F.month("shipped_at")).cast("long"), F.lit(-1))
    own = lambda c: F.when(sale, F.lit(-1)).otherwise(c)
    rows = lines.select(
        own(F.col("vendor_id")).cast("long").alias("vendor_id"), own(part).cast("long").alias("part"), own(month).cast("long").alias("month"), F.floor(F.col("quantity") / 10).cast("long").alias("tens"), whole(100 * F.col("discount")).alias("percent"),
        "sale_id", F.col("line_no").cast("long").alias("line_no"), F.col("quantity").cast("long").alias("quantity"), whole(100 * F.col("amount")).alias("amount_cents"))
    found = bit_slices.first_places(rows, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"])
    return found.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_simhash, op4_suffix_dedup, op5_topk, op6_url_templates, op7_main_text, op8_toxicity, op9_warc, op10_decontaminate, op11_trie_bpe, op12_word_variants, op13_bit_slices)}
ORACLES: dict[str, str] = {
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
""",
    "op1_substring_dedup": twins.OP1,
    "op4_suffix_dedup": twins.OP4,
    "op6_url_templates": url_templates.ORACLE,
    "op7_main_text": twins.OP7,
    "op9_warc": twins.OP9,
    "op10_decontaminate": twins.OP10,
    "op12_word_variants": twins.OP12,
    "op13_bit_slices": twins.OP13,
}
