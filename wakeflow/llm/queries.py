"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeflow.llm import decontaminate, divergence, exact_dedup, jaccard_join, kneser_ney, langid_crf, lattice_lm, lexical_search, line_dedup, mixing, quality_rules, substring_dedup, toxicity_gru
from wakeflow.llm.common import read

#: the query's vocabulary file; the operator has no default
VOCABULARY = os.environ.get("WAKEFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def op6_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_crf.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_words")


def op4_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_held_out(read(spark, sf_dir, "documents"), VOCABULARY)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), alphabet=kneser_ney.BYTES)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(read(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_lattice_likelihood": op4_lattice_likelihood,
    "op5_mix_sources": op5_mix_sources,
    "op6_benchmark_matches": op6_benchmark_matches,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op7_quality_rules": r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
     w as (select doc_id, source, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') as words,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as lines from d),
     base as (select doc_id, source, t, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
                     len(lines) - len(list_distinct(lines)) as n_dup_lines, words from w),
     win as (select doc_id, i, array_to_string(words[i:i+4], ' ') as g from (select doc_id, words, unnest(range(1, n_words - 3)) as i from base where n_words >= 5)),
     again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
     rep as (select doc_id, sum(least(5, coalesce(nxt - i, 5))) as n_repeat_words from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from again) group by doc_id),
     ln as (select doc_id, source, t, trim(lower(x)) as line, length(regexp_replace(x, '[ \x09-\x0D]', '', 'g')) as chars
            from (select doc_id, source, t, unnest(string_split(t, chr(10))) as x from d) where trim(lower(x)) <> ''),
     hosts as (select source, count(distinct t) as n from d group by source),
     freq as (select f.source, f.line from (select source, line, count(distinct t) as n from ln group by 1, 2) f
              join hosts h on f.source is not distinct from h.source where f.n > 20 and f.n > 0.01 * h.n),
     rem as (select ln.doc_id, sum(ln.chars) as removed_chars from ln join freq on ln.line = freq.line and ln.source is not distinct from freq.source group by 1),
     j as (select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed_chars, 0)::bigint as removed_chars
           from base b left join rep using (doc_id) left join rem using (doc_id)),
     f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from j)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and word_chars - removed_chars >= 40 and word_chars - removed_chars >= 0.3 * word_chars) as kept, removed_chars
from f
""",
    "op11_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
""",
    "op12_source_divergence": r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
     tok as (select doc_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
     kept as (select lang, term from tok group by all having count(distinct doc_id) >= 10),
     v as (select lang, count(*) as v from kept group by all),
     grp as (select g.lang, g.source, coalesce(v.v, 0) as v from (select distinct lang, source from d) g left join v on g.lang = v.lang),
     c as (select tok.lang, tok.source, tok.term, count(*) as c from tok join kept on tok.lang = kept.lang and tok.term = kept.term group by all),
     n as (select lang, source, sum(c)::bigint as n from c group by all),
     ln as (select lang, term, sum(c)::bigint as c from c group by all),
     lt as (select lang, sum(c)::bigint as n from ln group by all),
     p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * g.v) as p
           from grp g join kept k on g.lang = k.lang
           left join n on n.lang = g.lang and n.source = g.source
           left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
     q as (select ln.lang, ln.term, 1 + (1000000000 * (ln.c + 2)) // (lt.n + 2 * v.v) as q from ln join lt on ln.lang = lt.lang join v on v.lang = ln.lang),
     f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
           from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
     pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
              from grp a join grp b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
     term as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q)) as value
              from p join q on p.lang = q.lang and p.term = q.term where p.c > 0 and p.p > q.q),
     r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
""",
    "op13_lexical_search": r"""
with d as (select row_number() over () as row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
     tok as (select row, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
     len as (select row, count(*) as n from tok group by all),
     total as (select count(*) as n, sum(n)::bigint as l from len),
     tf as (select row, doc_id, term, count(*) as tf from tok group by all),
     q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
     w as (select term, floor(1000 * ln((2 * total.n + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total group by term, total.n),
     s as (select q.item_id, tf.row, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * len.n * total.n) // total.l))))::bigint as score
           from q join tf on q.term = tf.term join w on w.term = q.term join len on len.row = tf.row, total group by all),
     r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r where rank <= 50
""",
}
