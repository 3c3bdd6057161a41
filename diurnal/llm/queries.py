"""The operators as named queries over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurnal.session import scratch_dir

from . import decontamination, infilling, knnjoin, langid, linededup, merkle, mixing, sentencepieces, simhash, spanprints, token_counts, tokenstore, toxicity
from .common import crc_remainder, prepare, table


def op1_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix with 150 % of all words takes of each document."""
    plan = mixing.plan(table(spark, sf, "documents"))
    taken = (F.col("size") * F.size("draws")).cast("long").alias("taken")
    return plan.select(F.col("key").alias("doc_id"), "size", "source_size", "target", taken)


def op2_language(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language, learned from documents with crc32(doc_id) mod 3 other than 1."""
    docs = table(spark, sf, "documents")
    network = langid.fit(docs.where(crc_remainder("doc_id", 3) != 1))
    out = langid.identify(docs, network)
    return out.select("doc_id", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 best partners by integer inner product of every 50th vector."""
    vectors = table(spark, sf, "embeddings")
    return knnjoin.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return sentencepieces.digests(sentencepieces.round_trip(table(spark, sf, "documents")))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity scores, learned from documents with crc32(doc_id) mod 4 other than 2."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels.where(crc_remainder("doc_id", 4) != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "neighbours")


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts, and the longest prefix within 2048 tokens."""
    return token_counts.token_counts(table(spark, sf, "documents"))


def op7_token_store(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place in a token store, found by its index, and the checksum read there."""
    path = scratch_dir(spark, "token-store")
    tokenstore.write(table(spark, sf, "documents"), path)
    read = tokenstore.read_checksums(spark, path)
    places = tokenstore.lookup(spark, path, read.select("key", "occurrence"))
    joined = read.withColumnsRenamed({"key": "k", "occurrence": "o"}).join(places, F.col("k").eqNullSafe(F.col("key")) & (F.col("o") == F.col("occurrence")))
    return joined.select(F.col("k").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints over four-word shingles and their components at four bits or fewer."""
    out = simhash.near_duplicates(table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines dropped because ten or more documents have them."""
    out = linededup.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix-hash fingerprints of documents and of their edited texts."""
    return spanprints.document_fingerprints(table(spark, sf, "documents"))


def op11_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Merkle proofs of all documents, folded again after line breaks were deleted from half of them."""
    docs = table(spark, sf, "documents")
    tampered = F.when(crc_remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = merkle.build(merkle.leaves(docs, now=merkle.changed_leaf(text=tampered)), fanout=3)
    proofs = manifest.proofs()
    text = lambda d: F.lower(F.hex(d))
    root = F.lit((manifest.root or b"").hex())
    folded = text(merkle.fold(F.col("now"), F.col("path")))
    out = proofs.select(F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_infilling(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of fill-in-the-middle outputs, and of the texts restored from them."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    made = infilling.fill_in_middle(table(spark, sf, "documents")).withColumn("output_sha256", sha("output"))
    return infilling.restore(made).withColumn("restored_sha256", sha("restored")).drop("restored")


def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of documents inside ten-word windows of benchmark items, and these items."""
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _with_package(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf)

    return run


_ALL = (op1_mix, op2_language, op3_top_k, op4_sentencepiece, op5_toxicity, op6_token_counts, op7_token_store, op8_simhash, op9_line_dedup, op10_fingerprints, op11_manifest, op12_infilling, op13_decontamination)
QUERIES = {f.__name__: _with_package(f) for f in _ALL}

_OP1 = """
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
           substr(md5('mix:' || coalesce(doc_id::varchar, '')), 9, 24) as ord,
           ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint % 1024 as block
    from documents),
by_source as (
    select source, sum(size)::bigint as source_size,
           ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
    from sized group by source),
leveled as (
    select *, 2 * source_size as cap, (2 * source_size)::double / weight as fill,
           (sum(source_size) over () * 1.5::double - coalesce(sum(2 * source_size) over before, 0))::double
               / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
    from by_source
    window before as (order by (2 * source_size)::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
water as (select level as water from leveled where level <= fill order by fill, source nulls last limit 1),
goal as (
    select source, source_size, least(cap::double, coalesce(water * weight, cap::double)) as target,
           case when source_size > 0 then floor(least(cap::double, coalesce(water * weight, cap::double)) / source_size)::bigint else 0 end as passes
    from leveled left join water on true),
blocks as (
    select s.source, s.block, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size as rest, sum(s.size)::bigint as words
    from sized s join goal g on s.source is not distinct from g.source group by all),
placed as (
    select *, coalesce(sum(words) over (partition by source order by md5('mix:' || block::varchar), block rows between unbounded preceding and 1 preceding), 0) as before
    from blocks),
rowed as (
    select s.*, p.source_size, p.target, p.passes, (p.before < p.rest)::int as again,
           case when p.before < p.rest and p.before + p.words > p.rest then p.rest - p.before end as room,
           sum(s.size) over (partition by s.source, s.block order by s.ord, s.doc_id, s.size rows unbounded preceding) as until
    from sized s join placed p on s.source is not distinct from p.source and s.block = p.block)
select doc_id, size::bigint as size, source_size::bigint as source_size, target::double as target,
       (size * (passes + case when room is not null and until - size / 2.0 > room then 0 else again end))::bigint as taken
from rowed
"""

_OP3 = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_OP9 = """
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, unnest(range(len(lines))) as i, lines from split),
keyed as (
    select doc_id, i, lines[i + 1] as line,
           translate(trim(lines[i + 1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from line),
frequent as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
marked as (select keyed.*, frequent.k is not null as gone from keyed left join frequent using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

_OP11 = """
with recursive crc as (
    select distinct doc_id from documents where doc_id is not null),
steps as (
    select doc_id, flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda k: [ascii(substr(doc_id::varchar, k::int, 1)), -1, -1, -1, -1, -1, -1, -1, -1])) as ops from crc),
checked as (
    select doc_id, xor(list_reduce(list_prepend(4294967295, ops), lambda c, o: case when o >= 0 then xor(c::bigint, o::bigint)
                       when c % 2 = 1 then xor((c // 2)::bigint, 3988292384::bigint) else (c // 2)::bigint end)::bigint, 4294967295::bigint) as crc from steps),
field as (
    select d.doc_id, d.source, coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id::varchar, '-') || coalesce(strlen(d.source) || ':' || d.source, '-')
           || coalesce(strlen(d.lang) || ':' || d.lang, '-') || coalesce(strlen(d.n_chars::varchar) || ':' || d.n_chars::varchar, '-') as head,
           d.text, case when c.crc % 2 = 0 then replace(d.text, chr(10), '') else d.text end as tampered
    from documents d left join checked c on d.doc_id = c.doc_id),
hashed as (
    select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) as tampered_leaf from field),
placed as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from hashed),
tree as (
    select source, 0 as level, list(leaf order by i) as nodes from placed group by source
    union all
    select source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(list_slice(nodes, 3 * k + 1, 3 * k + 3), '')))
    from tree where len(nodes) > 1),
subroots as (
    select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as g from tree where len(nodes) = 1),
over_sources as (
    select 0 as level, list(subroot order by g) as nodes from subroots
    union all
    select level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(array_to_string(list_slice(nodes, 3 * k + 1, 3 * k + 3), '')))
    from over_sources where len(nodes) > 1),
numbered as (
    select row_number() over () as row, p.*, s.subroot, s.g from placed p join subroots s on p.source is not distinct from s.source),
walk as (
    select n.row, t.level, t.nodes, n.i // (3 ** t.level)::bigint as pos
    from numbered n join tree t on t.source is not distinct from n.source where len(t.nodes) > 1
    union all
    select n.row, 1000 + o.level, o.nodes, n.g // (3 ** o.level)::bigint from numbered n, over_sources o where len(o.nodes) > 1),
beside as (
    select row, level, array_to_string(list_slice(nodes, pos - pos % 3 + 1, pos), '') as l, array_to_string(list_slice(nodes, pos + 2, pos - pos % 3 + 3), '') as r from walk),
path as (select row, list({l: l, r: r} order by level) as path, string_agg(l || r, '' order by level) as proof from beside group by row),
folds as (
    select n.row, 1 as step, n.tampered_leaf as d from numbered n
    union all
    select f.row, f.step + 1, sha256(p.path[f.step].l || f.d || p.path[f.step].r) from folds f join path p on f.row = p.row where f.step <= len(p.path)),
last as (select row, arg_max(d, step) as folded_root from folds group by row),
top as (select nodes[1] as root from over_sources where len(nodes) = 1)
select n.doc_id, n.leaf, n.subroot, top.root, sha256(coalesce(p.proof, '')) as proof_sha256, l.folded_root, l.folded_root = top.root as verified
from numbered n join last l on n.row = l.row left join path p on n.row = p.row, top
"""

_OP12 = r"""
with hashed as (
    select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines from documents),
drawn as (
    select *, len(lines) as n, ('0x' || substr(h, 1, 8))::bigint % (len(lines) + 1) as h1, ('0x' || substr(h, 9, 8))::bigint % (len(lines) + 1) as h2,
           ('0x' || substr(h, 17, 8))::bigint % 100 as h3, ('0x' || substr(h, 25, 8))::bigint % 100 as h4 from hashed),
cut as (
    select *, array_to_string(list_slice(lines, 1, least(h1, h2)), '') as prefix,
           array_to_string(list_slice(lines, least(h1, h2) + 1, greatest(h1, h2)), '') as middle,
           array_to_string(list_slice(lines, greatest(h1, h2) + 1, n), '') as suffix,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 100 then 'plain'
                when h4 < 50 then 'spm' else 'psm' end as form from drawn)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from cut
"""

_OP13 = r"""
with words as (
    select row_number() over () as row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents),
item as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark),
start as (select item_id, w, least(len(w), 10) as size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from item where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as window from start),
sizes as (select distinct size from windows),
place as (select row, w, unnest(range(1, len(w) + 1)) as i from words),
found as (
    select p.row, p.i, s.size, x.item_id from place p, sizes s, windows x
    where p.i + s.size - 1 <= len(p.w) and x.size = s.size and x.window = array_to_string(list_slice(p.w, p.i, p.i + s.size - 1), ' ')),
hit as (select row, count(distinct k) as n_hit from (select row, unnest(range(i, i + size)) as k from found) group by row),
named as (
    select row, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct row, item_id::varchar as id from found where item_id is not null) group by row)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (row) left join named using (row)
"""

ORACLES = {"op1_mix": _OP1, "op3_top_k": _OP3, "op9_line_dedup": _OP9, "op11_manifest": _OP11, "op12_infilling": _OP12, "op13_decontamination": _OP13}
