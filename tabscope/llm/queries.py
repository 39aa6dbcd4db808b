"""One query per operator, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import (
    ann,
    bpe,
    jaccard,
    lexical,
    licenses,
    lines,
    merkle,
    packing,
    pii,
    quality,
    sharding,
    substrings,
    urls,
)
from tabscope.llm.common import read_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return keep


BLANK_WORDS = r"[^\x20\x09-\x0D]+"
PASSAGE_SQL = f"""with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{BLANK_WORDS}') words from documents),
p as (select doc_id, len(words) n, unnest(words) word, unnest(range(len(words))) i from w),
k as (select doc_id, n, i, md5(string_agg(word, ' ') over (partition by doc_id order by i
  rows between current row and 19 following)) h from p),
r as (select doc_id, i, row_number() over (partition by h order by doc_id, i) place from k where i + 20 <= n),
gone as (select distinct doc_id, unnest(range(i, i + 20)) i from r where place > 1),
kept as (select doc_id, string_agg(word, ' ' order by i) t, count(*) n from p anti join gone using (doc_id, i) group by 1)
select doc_id, len(words)::bigint n_words, (len(words) - coalesce(n, 0))::bigint n_removed,
  sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id)"""
JACCARD_SQL = f"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{BLANK_WORDS}') words from documents),
p as (select doc_id, len(words) n, unnest(words) word, unnest(range(len(words))) i from w),
k as (select doc_id, n, i, md5(string_agg(word, ' ') over (partition by doc_id order by i
  rows between current row and 3 following)) h from p),
s as (select distinct doc_id, h from k where i = 0 or i + 4 <= n),
c as (select doc_id, count(*) n from s group by 1),
m as (select a.doc_id x, b.doc_id y, count(*) m from s a join s b using (h) where a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from m join c a on x = a.doc_id join c b on y = b.doc_id where 100 * m >= 85 * (a.n + b.n - m)),
e as (select x, y from l union all select y, x from l),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, e.y from reach join e on reach.r = e.x)
select doc_id, coalesce(any_value(c.n), 0)::bigint n_shingles, min(r) component_id
from reach left join c using (doc_id) group by doc_id"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL_SQL = f"""with t as (select row_number() over () k, doc_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERMS}') terms from documents where text is not null),
d as (select k, doc_id, len(terms) n, terms from t where len(terms) > 0),
s as (select count(*) docs, sum(n)::bigint total from d),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{TERMS}')) term from benchmark),
w as (select k, unnest(terms) term from d),
f as (select k, term, count(*) tf from w where term in (select term from q) group by all),
x as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint w from f, s group by term),
r as (select item_id, k, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint score
  from q join f using (term) join x using (term) join d using (k), s group by all),
o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) place
  from r join d using (k) where score > 0)
select item_id, place::int as rank, doc_id, score from o where place <= 10"""
MANIFEST_SQL = """with recursive crc as (
  select list(list_reduce(list_prepend(n, range(8)), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) t from range(256) r(n)),
d as (select row_number() over () k, * from documents),
f as (select k, source, doc_id, text, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-')
  || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
  || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') head, replace(text, chr(10), '') short,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 hit from d, crc),
leaves as (select k, source, doc_id, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) leaf,
  case when hit and text is not null then sha256(head || octet_length(encode(short)) || ':' || short) end changed from f),
up(source, level, idx, digest, n) as (
  select source, 0, row_number() over (partition by source order by doc_id nulls first, leaf) - 1, leaf,
    count(*) over (partition by source) from leaves
  union all select source, level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), any_value((n + 2) // 3)
  from up where n > 1 group by source, level, idx // 3),
tops(level, idx, digest, n) as (
  select 0, row_number() over (order by source nulls first) - 1, digest, count(*) over () from up where n = 1
  union all select level + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), any_value((n + 2) // 3)
  from tops where n > 1 group by level, idx // 3),
own as (select k, doc_id, source, leaf, changed,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i from leaves),
src as (select source, digest subroot, row_number() over (order by source nulls first) - 1 s from up where n = 1),
steps as (
  select k, 0 part, u.level, coalesce(string_agg(digest, '' order by idx) filter (idx < i // (3 ** level)::bigint), '') l,
    coalesce(string_agg(digest, '' order by idx) filter (idx > i // (3 ** level)::bigint), '') r
  from own o join up u on o.source is not distinct from u.source and u.n > 1 and u.idx // 3 = i // (3 ** (level + 1))::bigint group by all
  union all select k, 1, t.level, coalesce(string_agg(digest, '' order by idx) filter (idx < s // (3 ** level)::bigint), ''),
    coalesce(string_agg(digest, '' order by idx) filter (idx > s // (3 ** level)::bigint), '')
  from own o join src on o.source is not distinct from src.source join tops t on t.n > 1 and t.idx // 3 = s // (3 ** (level + 1))::bigint
  group by all),
paths as (select k, list(l || '|' || r order by part, level) p, string_agg(l || r, '' order by part, level) proof from steps group by k)
select doc_id, leaf, subroot, tops.digest root, sha256(coalesce(proof, '')) proof_sha256,
  list_reduce(list_prepend(coalesce(changed, leaf), coalesce(p, [])),
    lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) folded_root, folded_root = tops.digest verified
from own left join paths using (k) join src on own.source is not distinct from src.source join tops on tops.n = 1"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_columns(spark, sf_dir, "documents", "doc_id", "text")


def vocabulary(name: str) -> str:
    """A vocabulary file of the installed package, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(documents(spark, sf_dir))


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query("op3_substring_dedup", PASSAGE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passage_report(documents(spark, sf_dir))


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


@query("op5_permutation_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit_urls(urls.labelled_urls(spark))
    return urls.judge_urls(read_columns(spark, sf_dir, "pages", "page_id", "url"), model)


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))[0]


@query("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


@query("op10_jaccard_join", JACCARD_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_report(documents(spark, sf_dir))


@query("op11_lexical_search", LEXICAL_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), read_columns(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op12_line_field")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_columns(spark, sf_dir, "labels", "doc_id", "quality")
    return lines.quality_scores(documents(spark, sf_dir), labels)


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(read_columns(spark, sf_dir, "documents", *merkle.FIELDS))
