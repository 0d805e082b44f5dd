"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digests

    return digests(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests

    return digests(_table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import groups

    return groups(_table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import groups

    return groups(_table(spark, sf_dir, "embeddings"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import compared

    return compared(_table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predictions

    return predictions(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import predictions

    return predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def base_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds by format alone."""
    return op3_pii(spark, sf_dir).drop("spans", "n_spans")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 finds by the base rules alone."""
    return op7_secrets(spark, sf_dir).drop("spans", "n_spans")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that op8 compares."""
    return op8_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_langid": op2_langid,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_embeddings": op5_embeddings,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_imatch": op8_imatch,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
    "base_entities": base_entities,
    "base_secrets": base_secrets,
    "edited_texts": edited_texts,
}

#: Rows (id, n_own, n_linked, component_id) out of tables items (id, n_own) and links (a, b) in both directions.
_GROUPS = """reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, min(b) as m from reach group by a), many as (select a, count(*) as n from links group by a),
grouped as (select id, n_own, coalesce(n, 0)::bigint as n_linked, least(id, coalesce(m, id)) as component_id from items left join low on id = low.a left join many on id = many.a)"""

_NEAR_DUPLICATES = f"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id as id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
items as (select id, len(s)::bigint as n_own from s), e as (select id, unnest(s) as g from s),
c as (select x.id as a, y.id as b, count(*) as c from e x join e y on x.g = y.g and x.id <> y.id group by 1, 2),
links as (select c.a, c.b from c join items i on c.a = i.id join items j on c.b = j.id where 100 * c >= 85 * (i.n_own + j.n_own - c)),
{_GROUPS} select id as doc_id, n_own as n_shingles, component_id, id = component_id as kept from grouped"""

_NEAR_VECTORS = f"""with recursive v as (select vec_id as id, embedding::double[] as v, embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fit from embeddings),
items as (select id, 0 as n_own from v), good as (select id, v from v where fit),
links as (select x.id as a, y.id as b from good x join good y on x.id <> y.id and len(x.v) = len(y.v) where list_cosine_similarity(x.v, y.v) >= 0.95),
{_GROUPS} select id as vec_id, n_linked as n_links, component_id, id = component_id as kept from grouped"""


def _spans(rank: int, kind: str, pattern: str, keep: str, group: int = 0) -> str:
    """Matches of one kind that are kept, with their places: what lies before each match is as long as the parts between matches, and the matches."""
    found = f"select doc_id, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as g, regexp_split_to_array(t, '{pattern}') as s from d"
    each = f"select doc_id, unnest(range(1, len(m) + 1)) as i, m, g, s from ({found})"
    start = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"select doc_id, {rank} as rank, '{kind}' as kind, ({start})::bigint as start, m[i] as value, g[i] as part from ({each}) where {keep}"


def _counted(kinds: dict[str, str], spans: list[str]) -> str:
    counts = ", ".join(f"(count(*) filter (where kind = '{k}'))::bigint as n_{k}" for k in kinds)
    said = "string_agg(kind || ':' || start || ':' || (start + length(value)), ',' order by start, rank)"
    return f"with d as (select doc_id, coalesce(text, '') as t from documents), f as ({' union all '.join(spans)}) select d.doc_id, {counts}, sha256(coalesce({said}, '')) as base_sha256 from d left join f using (doc_id) group by d.doc_id"


_DIGITS = "regexp_replace(m[i], '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda k: case when k % 2 = 0 then reverse({_DIGITS})[k + 1]::int when reverse({_DIGITS})[k + 1]::int > 4 then 2 * reverse({_DIGITS})[k + 1]::int - 9 else 2 * reverse({_DIGITS})[k + 1]::int end)) % 10 = 0"
_PII = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "len(list_filter(string_split(m[i], '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0"),
    "card": ("[0-9](?:[\\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
}
_SECRETS = {
    "assign": ("((?i)password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "length(g[i]) >= 12", 2),
    "access": ("AKIA[A-Z0-9]+", "length(m[i]) >= 18"),
    "hex": ("[0-9a-f]+", "length(m[i]) >= 16"),
}

#: Models, automata, random subsets and a tokenizer are beyond SQL; tests/llm compares the other queries with brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": _NEAR_DUPLICATES,
    "op5_embeddings": _NEAR_VECTORS,
    "base_entities": _counted(_PII, [_spans(r, k, *v) for r, (k, v) in enumerate(_PII.items())]),
    "base_secrets": _counted(_SECRETS, [_spans(r, k, *v) for r, (k, v) in enumerate(_SECRETS.items())]),
    "edited_texts": "with d as (select doc_id, coalesce(text, '') as t from documents), n as (select *, coalesce(lead(t) over (order by doc_id), first_value(t) over (order by doc_id)) as f from d), k as (select *, (length(t) // 4)::int as k from n) select doc_id, length(t)::bigint as n_chars, sha256(substr(t, 1, length(t) - k) || substr(f, 1, k)) as edited_sha256 from k",
}
