"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbitile.llm import bpe_tree, decontaminate, jaccard_join, language, line_dedup, media, near_dedup, periodic, pii, prefix_trie, token_ids, toxicity, trie_counts
from orbitile.llm.shared import table


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file of a public tokenizer, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), floor=1)


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_records(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op5_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), pretoken_pattern())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_decontamination": op1_simhash_decontamination,
        "op2_ftrl_toxicity": op2_ftrl_toxicity,
        "op3_token_records": op3_token_records,
        "op4_webp_media": op4_webp_media,
        "op5_bpe_tree": op5_bpe_tree,
        "op6_trie_token_counts": op6_trie_token_counts,
        "op7_bootstrapped_pii": op7_bootstrapped_pii,
        "op8_minhash_near_dedup": op8_minhash_near_dedup,
        "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
        "op10_language_id": op10_language_id,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_periodic_runs": op13_periodic_runs,
    }


def _linked_sets(percent: int) -> str:
    """Links by their definition: shingle sets, equal sets as one, all pairs that share a shingle, closure."""
    return rf"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words from documents where text is not null),
s as (select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) when len(words) > 0 then [concat(len(words), ':', array_to_string(words, ' '))] else cast([] as varchar[]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
sets as (select n.doc_id, n.n, md5(string_agg(shingle, chr(10) order by shingle)) as h from s join n using (doc_id) group by n.doc_id, n.n),
reps as (select h, min(doc_id) as rep from sets group by h),
r as (select s.doc_id, s.shingle, n.n from s join n using (doc_id) join reps on reps.rep = s.doc_id),
pairs as (select a.doc_id as a, b.doc_id as b from r a join r b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
edges as (select a, b from pairs union select b, a from pairs),
reach(a, b) as (select rep, rep from reps union select reach.a, edges.b from reach join edges on reach.b = edges.a),
label as (select a as rep, min(b) as component from reach group by a),
linked as (select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(label.component, d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id left join sets on sets.doc_id = d.doc_id left join reps on reps.h = sets.h left join label on label.rep = reps.rep)
"""


NEAR_DUPLICATES = _linked_sets(75) + "select doc_id, n_shingles, component_id, component_id = doc_id as kept from linked"
JACCARD_JOIN = _linked_sets(80) + "select doc_id, n_shingles, component_id from linked"


def _crc32(column: str) -> str:
    """crc32 of the decimal text of an integer column."""
    step = "list_reduce(range(8), lambda y, k: xor(y >> 1, (y & 1) * 3988292384), xor(s, b))"
    return f"xor(list_reduce(list_transform(range(1, length(cast({column} as varchar)) + 1), lambda c: cast(ascii(substr(cast({column} as varchar), c, 1)) as bigint)), lambda s, b: {step}, cast(4294967295 as bigint)), 4294967295)"


#: Nodes by their prefixes written out; a subtree is what begins with its top's prefix.
CONVERSATION_TRIE = f"""with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) as pos,
md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as turn_key, strlen(coalesce(text, '')) as size from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, {_crc32("conv_id")} % 9 as h from t group by conv_id),
taken as (select c.conv_id, c.h, c.n, least(c.h, coalesce(b.n, 0)) as k from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5),
turns as (select x.conv_id, t.pos, t.turn_key, t.size from taken x join t on t.conv_id = x.conv_id - x.conv_id % 5 and t.pos <= x.k
union all select x.conv_id, t.pos - x.h + x.k, t.turn_key, t.size from taken x join t on t.conv_id = x.conv_id and t.pos > x.h),
m as (select conv_id, pos as depth, size, md5(string_agg(turn_key, ',') over (partition by conv_id order by pos)) as prefix from turns
union all select conv_id, 0, 0, '' from convs),
last as (select conv_id, max(depth) as depth from m group by conv_id),
nodes as (select prefix, min(m.conv_id) as conv_id, max(m.depth) as depth, count(*) as n_convs, (count(*) - 1) * max(size) as saved,
sha256(coalesce(string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id) filter (where last.depth = m.depth), '')) as ends_sha256 from m join last on last.conv_id = m.conv_id group by prefix),
up as (select n.prefix, p.prefix as parent, pn.conv_id as parent_conv_id from nodes n left join m p on p.conv_id = n.conv_id and p.depth = n.depth - 1 left join nodes pn on pn.prefix = p.prefix),
kids as (select parent as prefix, count(*) as n_children from up where parent is not null group by parent),
sums as (select m.prefix, sum(case when k.prefix is null then 1 else 0 end) as n_leaves, sum(n.saved) as saved_tokens from nodes n join m on m.conv_id = n.conv_id and m.depth <= n.depth left join kids k on k.prefix = n.prefix group by m.prefix)
select n.conv_id, n.depth, up.parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) as n_children, cast(sums.n_leaves as bigint) as n_leaves, cast(sums.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from nodes n join up using (prefix) join sums using (prefix) left join kids using (prefix)"""

#: Runs by their definition: words p apart that are equal, islands of them, none within a run of smaller period.
PERIODIC_RUNS = rf"""with w0 as (select doc_id, {_crc32("doc_id")} as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words from documents),
w1 as (select *, len(words) as n, h // 10 as g from w0),
w2 as (select *, g % greatest(n, 1) as a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) as p from w1),
w3 as (select doc_id, n, unnest(words) as word, unnest(range(0, n)) as i, h, a, p from w2),
w4 as (select doc_id, i, case when h % 10 = 0 and i >= a then a + (i - a) % p else i end as j from w3),
w as (select w4.doc_id, w4.i, w3.word, w3.n from w4 join w3 on w3.doc_id = w4.doc_id and w3.i = w4.j),
same as (select x.doc_id, x.i, y.i - x.i as q from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from same),
stretches as (select doc_id, q, min(i) as s, count(*) + q as l from islands group by doc_id, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select * from stretches a where not exists (select 1 from stretches b where b.doc_id = a.doc_id and b.q < a.q and b.s <= a.s and b.s + b.l >= a.s + a.l)),
listed as (select doc_id, count(*) as n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' order by s, q) as lines, arg_min(struct_pack(s := s, l := l, q := q), struct_pack(e := -(l / q), s := s, q := q)) as best from runs group by doc_id),
kept as (select w.doc_id, string_agg(word, ' ' order by i) as collapsed from w where not exists (select 1 from runs r where r.doc_id = w.doc_id and w.i >= r.s + r.q and w.i < r.s + r.l) group by w.doc_id)
select d.doc_id, coalesce(x.n_runs, 0) as n_runs, x.best.s as start, x.best.l as length, x.best.q as period, 1000 * x.best.l // x.best.q as exponent_milli,
sha256(coalesce(x.lines, '')) as runs_sha256, sha256(coalesce(k.collapsed, '')) as collapsed_sha256
from documents d left join listed x on x.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express."""
    return {"op8_minhash_near_dedup": NEAR_DUPLICATES, "op11_conversation_trie": CONVERSATION_TRIE, "op12_jaccard_join": JACCARD_JOIN, "op13_periodic_runs": PERIODIC_RUNS}
