"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm.common import read
from markloom.llm.exact import exact_groups
from markloom.llm.language import language_digest
from markloom.llm.licenses import license_scan
from markloom.llm.mixing import mix_digest
from markloom.llm.near import near_groups
from markloom.llm.packing import pack_digest
from markloom.llm.pii import personal_data
from markloom.llm.quality import quality
from markloom.llm.secrets import secret_scan
from markloom.llm.spelling import spelling_variants
from markloom.llm.substring import cut_repeats
from markloom.llm.toxicity import toxicity
from markloom.llm.whitening import whitened


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir))


def token_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(read(spark, sf_dir), token_file())


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir), read(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read(spark, sf_dir), k=2)
    return groups.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir)).drop("row")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(read(spark, sf_dir))


def op11_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(read(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_distribution_divergence": op3_distribution_divergence,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_language_spans": op11_language_spans,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": r"""
        with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
             starts as (select doc_id, w, unnest(range(1, len(w) - 11)) as s from words where len(w) > 12),
             windows as (select doc_id, s, min(doc_id) over (partition by array_to_string(w[s : s + 12], ' ')) as first_id from starts),
             gone as (select distinct doc_id, unnest(range(s, s + 13)) as pos from windows where first_id < doc_id),
             lists as (select doc_id, list(pos) as gone from gone group by 1),
             kept as (select doc_id, len(w) as n_words, len(coalesce(gone, [])) as n_removed,
                             case when gone is null then w else list_filter(w, lambda x, i: not list_contains(gone, i)) end as k
                      from words left join lists using (doc_id))
        select doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
    "op8_minhash_near_dedup": r"""
        with recursive
        words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
                                     else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
        items as (select doc_id, unnest(s) as item from sets),
        pairs as (select a.doc_id as a, b.doc_id as b, count(*) as both from items a join items b on a.item = b.item and a.doc_id <> b.doc_id group by 1, 2),
        links as (select p.a, p.b from pairs p join sets x on x.doc_id = p.a join sets y on y.doc_id = p.b
                  where 100 * p.both >= 80 * (len(x.s) + len(y.s) - p.both)),
        reach as (select doc_id as start, doc_id as node from documents union select r.start, l.b from reach r join links l on l.a = r.node),
        firsts as (select start, min(node) as component_id from reach group by 1)
        select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join firsts on start = doc_id""",
    "op9_exact_dedup": r"""
        with bare as (select doc_id, length(coalesce(text, '')) as n,
                             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as bare from documents),
             best as (select *, first_value(doc_id) over (partition by bare order by n desc, doc_id) as keep_id,
                             count(*) over (partition by bare) as group_size from bare)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from best""",
    "op12_spelling_variants": r"""
        with recursive
        steps as (select list(list_reduce(range(0, 8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, b) order by b) as t
                  from (select unnest(range(0, 256)) as b)),
        runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
        low as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
                from runs where length(run) >= 7 group by 1, 2),
        bytes as (select run, c, hex(encode(doc_id || ':' || run)) as x from low),
        sums as (select run, c, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::bigint),
                                                lambda s, b: xor(s // 256, t[(xor(s, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as h
                 from bytes cross join steps),
        words as (select case when h % 31 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end as word, sum(c)::bigint as n
                  from sums group by 1 having sum(c) >= 2 and length(word) >= 7),
        places as (select word, n, unnest(range(0, length(word) + 1)) as i from words),
        holes as (select word, n, word[: i] as a, word[i + 2 :] as b, word[i + 1 : i + 1] as letter from places where i < length(word)),
        other as (select a.word, b.word as near, b.n as near_n from holes a join holes b on a.a = b.a and a.b = b.b and a.letter <> b.letter),
        less as (select distinct h.word, h.n, w.word as near, w.n as near_n from holes h join words w on w.word = h.a || h.b),
        pairs as (select * from other union all select word, near, near_n from less union all select near, word, n from less),
        best as (select word, count(*) as n_near, first(near order by near_n desc, encode(near)) as near, max(near_n) as near_n from pairs group by 1),
        forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n
                  from words w left join best using (word)),
        up as (select word, word as at from forms union all select u.word, f.form from up u join forms f on f.word = u.at where f.form is not null),
        roots as (select u.word, u.at as root from up u join forms f on f.word = u.at where f.form is null)
        select word, form, root, n, n_near, form_n from forms join roots using (word)""",
}
