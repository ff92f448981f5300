"""One query per operator of this subpackage, with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm import (
    chat,
    collocations,
    decontaminate,
    fingerprints,
    langid,
    mixing,
    oddsketch,
    ranked,
    secrets,
    simhash,
    substrings,
    toxicity,
    urlfilter,
)
from trialgrid.llm.expressions import let
from trialgrid.queries.tables import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))
    own = fingerprints.mark_hashes(F.col("marks"))
    return both.select(
        "doc_id",
        F.length("body").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.fingerprint_text(F.col("marks")).alias("fingerprint"),
        fingerprints.fingerprint_text(F.col("edited_marks")).alias("edited_fingerprint"),
        fingerprints.likeness(own, fingerprints.mark_hashes(F.col("edited_marks"))).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_hashes")).alias("near_next"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).drop("component")


OP2_SQL = r"""
with recursive parts as (
  select page_id, strpos(coalesce(url, ''), '://') > 0 as good,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) as query
  from pages),
nodes as (
  select page_id, host, path, case when host <> '' then host || path || query end as node,
    case when host <> '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html?)?/?$', '')
      || coalesce('?' || nullif(array_to_string([x for x in string_split(query[2:], '&')
        if x <> '' and not regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)')], '&'), ''), '') end as usual
  from parts),
edges as (select distinct node as a, usual as b from nodes where node is not null),
sides as (select a, b from edges union select b, a from edges union select a, a from edges union select b, b from edges),
reach as (select a, b from sides union select reach.a, sides.b from reach join sides on reach.b = sides.a),
rules(host, path, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
places as (
  select a as node, regexp_extract(a, '(?s)^([^/?#]*)', 1) as host, regexp_extract(a, '(?s)^[^/?#]*([^?#]*)', 1) as path
  from (select distinct a from sides)),
ruled as (
  select node, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from places p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by 1),
inherited as (select reach.a as node, min(verdict) as verdict from reach join ruled on ruled.node = reach.b group by 1),
own as (
  select page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
  from nodes p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by 1)
select page_id, host, path, own.rule, coalesce(own.verdict, inherited.verdict, 'allow') as verdict
from nodes left join own using (page_id) left join inherited using (node)
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.scan_secrets(F.col("text")).alias("spans"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        of("assign"),
        of("access"),
        of("hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
        of("entropy"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn_severity(docs, table(spark, sf_dir, "labels"))
    judged = docs.select("doc_id", toxicity.predict_severity(model, F.col("text")).alias("p"))
    return judged.select("doc_id", "p.severity", "p.grade", "p.p_toxic", (F.col("p.p_toxic") >= 0.5).alias("toxic"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
with w as (
  select doc_id as id, true as is_doc, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents
  union all
  select item_id, false, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') from benchmark),
tests as (select id as item_id, w, least(5, len(w)) as k from w where not is_doc and len(w) > 0),
item_grams as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select item_id, k, w, unnest(range(1, len(w) - k + 2)) as i from tests)),
sizes as (select item_id, count(*) as n_item from item_grams group by 1),
doc_grams as (
  select distinct doc_id, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select id as doc_id, k, w, unnest(range(1, len(w) - k + 2)) as i
        from w, (select distinct k from tests) where is_doc and len(w) >= k))
select doc_id, item_id, count(*) as n_shared, n_item, count(*) / n_item as containment
from doc_grams join item_grams using (k, g) join sizes using (item_id)
group by doc_id, item_id, n_item having count(*) >= ceil(round(n_item * 0.8, 9))
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"))
    mixed = mixing.systematic_mix(docs, ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.lit("\\### Assistant: </turn> ok").alias("text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role, told)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    windows = chat.format_windows(turns)
    shown = chat.read_turns(F.col("formatted"))
    new = let(shown, lambda t: F.slice(t, F.col("n_repeated") + 1, F.size(t)))
    line = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = windows.select("conv_id", "window", "formatted", "loss", new.alias("new"))
    part = F.struct("window", line.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.sum(F.size("new")).cast("bigint").alias("n_turns"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.array_sort(F.collect_list(part)).alias("parts"),  # the digests need a conversation in one piece
    )
    turns_text, loss_text = (F.array_join(F.col(f"parts.{name}"), "") for name in ("turns", "loss"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text).cast("bigint").alias("loss_chars"),
        F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(table(spark, sf_dir, "documents")).drop("removed", "passages")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.learn_languages(docs.filter(~out))
    named = docs.select("doc_id", out.alias("held_out"), langid.identify_language(model, F.col("text")).alias("p"))
    return named.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with texts as (
  select doc_id as id, true as is_doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select item_id, false, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
terms as (
  select id, is_doc, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from texts),
lengths as (select id, count(*) as n from terms where is_doc group by 1),
corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from lengths),
tfs as (select id, term, count(*) as tf from terms where is_doc group by 1, 2),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from tfs, corpus group by term, n_docs),
scores as (
  select i.id as item_id, d.id as doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
  from (select distinct id, term from terms where not is_doc) i join tfs d using (term) join weights using (term)
    join lengths l on l.id = d.id cross join corpus
  group by 1, 2)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 50
"""


def op12_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.similar_components(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
links as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b using (s) join sizes m on m.doc_id = a.doc_id join sizes n on n.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by 1, 2, m.n, n.n having 100 * count(*) >= 85 * (m.n + n.n - count(*))),
reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x),
least as (select x as doc_id, min(y) as y from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id, doc_id <= coalesce(y, doc_id) as kept
from documents left join sizes using (doc_id) left join least using (doc_id)
"""


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
grams as materialized (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3]) as k from words) where len(w) >= k)),
f as materialized (select lang, k, phrase, count(*)::bigint as f from grams group by 1, 2, 3 having count(*) >= 10),
totals as (select lang, count(*)::bigint as n from grams where k = 1 group by 1),
candidates as materialized (select lang, k, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1),
cuts as (
  select c.lang, c.phrase, c.a, cut, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score
  from (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as head, array_to_string(w[cut + 1:k], ' ') as tail
        from (select *, unnest(range(1, k)) as cut from candidates)) c
    join f l on l.lang = c.lang and l.phrase = c.head join f r on r.lang = c.lang and r.phrase = c.tail),
scored as (
  select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as first from cuts) where first = 1),
inside as (
  select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as longer from (select lang, w, a, unnest([1, 2]) as i from candidates where k = 3) group by 1, 2)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select scored.*, n, row_number() over (partition by lang order by score desc, a desc, phrase)::int as rank
  from scored join totals using (lang) left join inside using (lang, phrase) where longer is null or 100 * longer < 50 * a)
where rank <= 2000
"""


QUERIES = {
    "op1_document_fingerprints": (op1_document_fingerprints, None),
    "op2_url_filter": (op2_url_filter, OP2_SQL),
    "op4_toxicity": (op4_toxicity, None),
    "op7_chat_format": (op7_chat_format, None),
    "op8_substring_dedup": (op8_substring_dedup, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op5_benchmark_decontamination": (op5_benchmark_decontamination, OP5_SQL),
    "op6_source_mixing": (op6_source_mixing, None),
    "op9_language_id": (op9_language_id, None),
    "op10_simhash_near_duplicates": (op10_simhash_near_duplicates, None),
    "op11_ranked_search": (op11_ranked_search, OP11_SQL),
    "op12_minhash_near_duplicates": (op12_minhash_near_duplicates, OP12_SQL),
    "op13_phrase_collocations": (op13_phrase_collocations, OP13_SQL),
}


def queries():
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
