"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import label_part, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op1_bpe_codec(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"), path or tokenizer_path())


def op4_token_store(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from .token_store import store_documents

    out = store_documents(table(spark, sf_dir, "documents"), path or tokenizer_path(), end_id=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of the document of the same number."""
    from .url_filter import judge_urls

    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes, URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark passage in a document; documents without any have no row."""
    from .decontaminate import benchmark_passages

    return benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    network = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", holdout_parts=5, holdout_part=0)
    held_out = (label_part(F.col("doc_id"), 5) == 0).alias("held_out")
    return toxicity.score(docs, network).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"), "quality", holdout_parts=3, holdout_part=1)
    held_out = (label_part(F.col("doc_id"), 3) == 1).alias("held_out")
    return quality.score(docs, ranking).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, learn

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs, holdout_parts=5))
    return out.select("doc_id", (label_part(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op11_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op12_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked import best_documents

    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_codec, op2_url_reputation, op3_benchmark_passages, op4_token_store, op5_minhash_near_dup, op6_sampled_splitters, op7_toxicity, op8_quality_ranking, op9_divergence_rules, op10_language_id, op11_entropy_mix, op12_k2_treap_search, op13_tiled_collocations)}


def _divergence_sql() -> str:
    from .quality_rules import CLASSES, COMMON_WORDS

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quoted(lang)}, {quoted(w)})" for lang, ws in COMMON_WORDS.items() for w in ws)
    kinds = ", ".join(f"({quoted(name)}, {quoted(pattern)})" for name, pattern in CLASSES.items())
    term = "case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end"
    return rf"""
with cw as (select * from (values {listed}) v(lang, word)),
ck as (select * from (values {kinds}) v(kind, pattern)),
t as (select row_number() over () rid, doc_id, lang, coalesce(text, '') txt from documents),
w as (
  select *, regexp_extract_all(txt, '[^ 	-
]+') ws,
    list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) lines from t),
b as (
  select rid, doc_id, lang, txt, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(txt) n_chars,
    length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')) n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines from w),
x as (select rid, unnest(ws) word, generate_subscripts(ws, 1) i from w),
tri as (select rid, i, word || ' ' || lead(word) over o || ' ' || lead(word, 2) over o tw from x window o as (partition by rid order by i)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, tw) n from tri where tw is not null) where n > 1),
cov as (select rid, count(distinct i + k) n_repeat_words from dup, (values (0), (1), (2)) v(k) group by 1),
ks as (select rid, lang, n_chars, kind, length(txt) - length(regexp_replace(txt, pattern, '', 'g')) n from b, ck),
ka as (select rid, lang, n_chars, kind, n from ks union all select rid, any_value(lang), any_value(n_chars), 'rest', any_value(n_chars) - sum(n) from ks group by 1),
lw as (select rid, lower(word) word, count(*) n from x where length(word) <= 4 group by 1, 2),
wc as (select b.rid, b.lang, cw.lang of_lang, cw.word, coalesce(n, 0) n, n_words from b cross join cw left join lw on lw.rid = b.rid and lw.word = cw.word),
wa as (
  select rid, lang, of_lang, word, n, n_words from wc
  union all select rid, any_value(lang), of_lang, ' rest', any_value(n_words) - sum(n), any_value(n_words) from wc group by rid, of_lang),
ok as (select lang from b where lang in (select lang from cw) group by 1 having count(*) >= 20 and sum(n_chars) > 0 and sum(n_words) > 0),
kr as (select lang, kind, sum(n)::double / sum(n_chars) q from ka join ok using (lang) group by 1, 2),
wr as (select lang, word, sum(n)::double / sum(n_words) q from wa join ok using (lang) where lang = of_lang group by 1, 2),
kd as (
  select rid, kr.lang, sqrt(greatest(sum({term}) / 2, 0)) d
  from (select rid, kind, n::double / greatest(n_chars, 1) p from ka) a join kr using (kind) group by 1, 2),
wd as (
  select rid, of_lang, sqrt(greatest(sum({term}) / 2, 0)) d
  from (select rid, of_lang, word, n::double / greatest(n_words, 1) p from wa) a join wr on wr.lang = a.of_lang and wr.word = a.word group by 1, 2),
k1 as (select rid, min(d) class_distance from kd group by 1),
w1 as (select rid, min(d) common_distance from wd group by 1),
f as (
  select b.*, coalesce(n_repeat_words, 0) n_rep, n_words < 50 or 100 * coalesce(n_repeat_words, 0) > 50 * n_words base_failed,
    coalesce(n_chars >= 200 and class_distance > 0.25, false) or coalesce(n_words >= 100 and common_distance > 0.295, false) far
  from b left join cov using (rid) left join k1 using (rid) left join w1 using (rid))
select doc_id, n_words::bigint n_words, word_chars::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines,
  n_rep::bigint n_repeat_words, base_failed, not base_failed and not far kept
from f
"""


SQL: dict[str, str] = {
    "op9_divergence_rules": _divergence_sql(),
    "op2_url_reputation": r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
c as (
  select host, count(quality) n, coalesce(sum(quality), 0) k from p left join (select doc_id, quality from labels where quality in (0, 1)) l on l.doc_id = p.page_id group by 1),
h0 as (select *, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') ls from c),
h1 as (select *, array_to_string(ls[-2:], '.') two from h0),
h as (
  select host, n, k,
    case when two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') then two else ls[-1] end suffix,
    case when two in ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk') then array_to_string(ls[-3:], '.') else two end dom
  from h1),
s0 as (select suffix, sum(n) n, sum(k) k, (select (sum(k) + 1.0::double) / (sum(n) + 2) from h) prior from h group by 1),
s1 as (select *, (select case when count(*) = 0 or sum(n) <= count(*) then 1.0::double else 1 / least(greatest((sum(n * pow(k / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)), 0.01), 0.9) - 1 end from s0 where n > 0) st from s0),
s as (select suffix, (k + prior * st) / (n + st) m from s1),
d0 as (select dom, sum(n) n, sum(k) k, any_value(m) prior from h join s using (suffix) group by 1),
d1 as (select *, (select case when count(*) = 0 or sum(n) <= count(*) then 1.0::double else 1 / least(greatest((sum(n * pow(k / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)), 0.01), 0.9) - 1 end from d0 where n > 0) st from d0),
d as (select dom, (k + prior * st) / (n + st) prior from d1),
g0 as (select host, n, k, prior from h join d using (dom)),
g1 as (select *, (select case when count(*) = 0 or sum(n) <= count(*) then 1.0::double else 1 / least(greatest((sum(n * pow(k / n - prior, 2) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)), 0.01), 0.9) - 1 end from g0 where n > 0) st from g0),
g as (select host, k + prior * st a, n - k + (1 - prior) * st b from g1),
t as (select host, a / (a + b) + 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) bound from g),
r as (select * from (values ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
  ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')) v(said, rule, rhost, rpath)),
b as (
  select host, path, arg_max(rule, length(rule)) rule, arg_max(said, length(rule)) said
  from (select distinct host, path from p) q join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1, 2)
select page_id, host, path, rule, coalesce(said, case when bound < 0.5 then 'block' else 'allow' end) verdict
from p join t using (host) left join b using (host, path)
""",
    "op12_k2_treap_search": r"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
q as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
g as (select count(distinct doc_id)::bigint nd, count(*)::bigint nl from t),
d as (select doc_id, count(*)::bigint n from t group by 1),
p as (select doc_id, term, count(*)::bigint tf from t where term in (select term from q) group by 1, 2),
w as (select term, floor(1000 * ln((2 * any_value(nd) + 2)::double / (2 * count(*) + 1)))::bigint w from p, g group by 1),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl))))::bigint score
  from q join p using (term) join w using (term) join d using (doc_id), g group by 1, 2),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int "rank", doc_id, score from s where score > 0)
select * from r where "rank" <= 20
""",
    "op13_tiled_collocations": r"""
with p as (
  select row_number() over () d, coalesce(lang, 'und') lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps from documents),
q as (select d, lang, i, regexp_extract_all(ps[i], '[^\x20\x09]+') ws from (select d, lang, ps, unnest(range(1, len(ps) + 1)) i from p)),
w as (select d, lang, i, ws, unnest(range(1, len(ws) + 1)) j from q),
f1 as (select lang, ws[j] a, count(*) n from w group by 1, 2),
f2 as (select lang, ws[j] a, ws[j + 1] b, count(*) n from w where j < len(ws) group by 1, 2, 3),
f3 as (select lang, ws[j] a, ws[j + 1] b, ws[j + 2] c, count(*) n from w where j + 1 < len(ws) group by 1, 2, 3, 4 having count(*) >= 10),
t as (select lang, sum(n)::bigint n from f1 group by 1),
c2 as (
  select f2.lang, f2.a || ' ' || f2.b phrase, f2.n a, x.n l, y.n r, (1000000 * f2.n::hugeint * f2.n) // (x.n::hugeint * y.n) score
  from f2 join f1 x on x.lang = f2.lang and x.a = f2.a join f1 y on y.lang = f2.lang and y.a = f2.b
  where f2.n >= 10 and not exists (
    select 1 from f3 where f3.lang = f2.lang and 100 * f3.n >= 50 * f2.n and ((f3.a = f2.a and f3.b = f2.b) or (f3.b = f2.a and f3.c = f2.b)))),
k3 as (
  select f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c phrase, f3.n a, x.n l1, yz.n r1, xy.n l2, z.n r2,
    (1000000 * f3.n::hugeint * f3.n) // (x.n::hugeint * yz.n) s1, (1000000 * f3.n::hugeint * f3.n) // (xy.n::hugeint * z.n) s2
  from f3 join f1 x on x.lang = f3.lang and x.a = f3.a join f1 z on z.lang = f3.lang and z.a = f3.c
    join f2 xy on xy.lang = f3.lang and xy.a = f3.a and xy.b = f3.b join f2 yz on yz.lang = f3.lang and yz.a = f3.b and yz.b = f3.c),
c as (
  select lang, phrase, a, l, r, score from c2
  union all select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from k3)
select lang, "rank", phrase, a, l, r, t.n, score::bigint score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) "rank" from c) join t using (lang) where "rank" <= 2000
""",
    "op5_minhash_near_dup": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
s as (
  select doc_id, unnest(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh
  from w),
c as (select doc_id, count(*) n from s group by 1),
l as (
  select a.doc_id x, b.doc_id y, count(*) n2 from s a join s b using (sh) where a.doc_id <> b.doc_id group by 1, 2),
e as (
  select x, y from l join c ca on ca.doc_id = x join c cb on cb.doc_id = y where 100 * n2 >= 75 * (ca.n + cb.n - n2)),
r as (select doc_id a, doc_id b from documents union select r.a, e.y from r join e on e.x = r.b),
m as (select a, min(b) component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept
from documents left join c using (doc_id) join m on m.a = doc_id
""",
}
