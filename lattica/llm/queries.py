"""The corpus operators as queries over the driver's tables; SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, html_text, language_mix, license_scan, lsh_forest, passages, topk, toxicity
from .common import cut, remainder, table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mix.fit(docs.where(remainder("doc_id", 4) != 2))
    return language_mix.identify(docs, model).withColumn("held_out", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "mixture")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    held = bpe.read_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_decode(table(spark, sf_dir, "documents"), held, pattern or public_tokenizers.PATTERN)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"select -7L conv_id, 0L turn, 'user' role, '{said}' text union all select -7L, 1L, 'assistant', '{said}'")
    messages = cut(chat.linear(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))
    done = cut(chat.format_paths(chat.chosen_paths(messages), messages))
    turns = chat.read_turns(F.col("formatted"))
    learnt = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substr("formatted", s["start"].cast("int"), s["size"].cast("int")))), "")
    read = done.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        F.when(F.col("conv_id") != chat.NO_ID, F.col("conv_id")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, lexicon).withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_html_text, op2_language_id, op3_substring_dedup, op4_license_scan, op5_exact_top_k, op6_byte_bpe, op7_chat_formatting, op8_toxicity, op9_decontamination, op10_minhash_near_dedup)}

TOP_K_SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over w as int) as "rank", vec_id, score from s window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20"""

_CONTROLS = r"<\||</?s>|<<SYS>>|<</SYS>>|\[/?INST\]"
_WRITTEN = f"length({{0}}) + length({{0}}) - length(replace({{0}}, chr(92), '')) + len(regexp_extract_all({{0}}, '{_CONTROLS}'))"
CHAT_SQL = f"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(chat.START) + len(chat.SEP) + len(chat.END)} + {_WRITTEN.format("role")} + {_WRITTEN.format("text")}) as bigint) as formatted_chars
from c group by conv_id"""

NEAR_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
d as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as own from w),
s as materialized (select doc_id, len(own) as n, hash(unnest(own)) as sh from d),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
k as materialized (select a, b from p where 100 * common >= 85 * (na + nb - common)),
e as (select a, b from k union all select b, a from k),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on r.other = e.a),
m as (select doc_id, min(other) as component_id from r group by 1)
select d.doc_id, cast(len(own) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept from d join m on d.doc_id = m.doc_id"""

ORACLES: dict[str, str] = {"op5_exact_top_k": TOP_K_SQL, "op7_chat_formatting": CHAT_SQL, "op10_minhash_near_dedup": NEAR_SQL}
