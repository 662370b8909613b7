"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language, lattice, merkle, mixing, near_dup, packing, quality, search, spelling, suffix_dedup, toxicity, url_filter
from .common import crc_mod, lower_ascii, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"select * from values {rows} as rules(host, path, verdict)")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    scored = quality.score_quality(table(spark, sf_dir, "documents"), learn)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), learn)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = search.top_k(docs, docs.where(F.col("doc_id") % 100 == 0), k=10)
    return found.withColumn("score", F.round("score", 6))


def op11_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.digest(*[F.col(c) for c in fields[:-1]], lower_ascii(F.col("text")))
    changed = F.when(crc_mod(F.col("doc_id"), 3) == 0, tampered)
    rows = merkle.manifest(table(spark, sf_dir, "documents"), fields, keep={"changed": changed})
    told = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), least=7, spoil=spelling.drop_letter(31))
    return spelling.variants(counts.where("n >= 2"), ratio=10).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_ann": op5_ann,
    "op6_quality": op6_quality,
    "op7_near_dup": op7_near_dup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_search": op10_search,
    "op11_lattice_dedup": op11_lattice_dedup,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling": op13_spelling,
}

#: crc32 in SQL: a list of 256 numbers made by rule, and its use on the bytes of a text {x}.
_CRCS = "crcs as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b)) as t)"
_CRC = "xor(list_reduce(list_transform(range(strlen({x})), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sides(name: str, group: str) -> str:
    """SQL of a tree over ``{name}_leaves(g, pos, h)``: its nodes by level, and (g, pos, level, before, after) for each leaf."""
    return f"""
        {name}_nodes(g, level, pos, h, n) as (
            select g, 0, pos, h, count(*) over ({group}) from {name}_leaves
            union all
            select * from (
                select g, level + 1, pos // 8, sha256(string_agg(h, '' order by pos)), count(*) over ({group}) from {name}_nodes where n > 1 group by g, level, pos // 8
            )
        ),
        {name}_sides as (
            select l.g, l.pos, s.level, coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos < l.pos >> 3 * s.level), '') as before,
                coalesce(string_agg(s.h, '' order by s.pos) filter (s.pos > l.pos >> 3 * s.level), '') as after
            from {name}_leaves l join {name}_nodes s on s.g is not distinct from l.g and s.pos >> 3 = l.pos >> 3 * (s.level + 1) and s.n > 1 group by l.g, l.pos, s.level
        ),
        {name}_roots as (select g, h from {name}_nodes where n = 1)
    """


ORACLE_SQL = {
    "op1_url_filter": """
        with rules(rule_host, rule_path, rule_verdict) as (
            values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ),
        cut as (
            select page_id, case when url is not null and strpos(url, '://') > 0
                then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') else '' end as rest
            from pages
        ),
        parts as (
            select page_id,
                translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path
            from cut
        ),
        fits as (
            select page_id, rule_host || rule_path as rule, rule_verdict as verdict,
                row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as place
            from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        )
        select parts.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
        from parts left join fits on parts.page_id = fits.page_id and place = 1
    """,
    # all pairs that share a shingle, then the smallest id reachable
    "op7_near_dup": """
        with recursive words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
        ),
        sets as (
            select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s from words
        ),
        items as (select doc_id, len(s) as n, unnest(s) as x from sets),
        links as (
            select a.doc_id as a, b.doc_id as b from items a join items b on a.x = b.x and a.doc_id < b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ),
        edges as (select a, b from links union all select b, a from links),
        reach(doc_id, other) as (select a, b from edges union select reach.doc_id, edges.b from reach join edges on reach.other = edges.a),
        lowest as (select doc_id, min(other) as other from reach group by 1)
        select sets.doc_id, len(s)::bigint as n_shingles, least(sets.doc_id, coalesce(other, sets.doc_id)) as component_id, sets.doc_id <= coalesce(other, sets.doc_id) as kept
        from sets left join lowest on sets.doc_id = lowest.doc_id
    """,
    # every string of 50 bytes as 100 hexadecimal digits
    "op8_suffix_dedup": """
        with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, ''))::bigint as n from documents),
        strings as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, greatest(n - 49, 0))) as i from t)),
        firsts as (select s, min(doc_id) as first from strings group by s having min(doc_id) < max(doc_id)),
        hits as (select doc_id, i from strings join firsts on strings.s = firsts.s where first < doc_id),
        marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from hits),
        runs as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from marked),
        spans as (select doc_id, run, min(i) as a, max(i) + 50 as z from runs group by doc_id, run),
        gaps as (
            select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) as lo, a as hi from spans
            union all select doc_id, max(z) as lo, null as hi from spans group by doc_id
        ),
        kept as (select t.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, n) - lo)), '' order by lo) as h from gaps join t on gaps.doc_id = t.doc_id group by t.doc_id),
        sums as (select doc_id, sum(z - a)::bigint as n_removed, count(*) as n_spans from spans group by doc_id)
        select t.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.h, t.h))) as kept_sha256
        from t left join sums on t.doc_id = sums.doc_id left join kept on t.doc_id = kept.doc_id
    """,
    "op10_search": """
        with words as (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) as w from documents
        ),
        counts as (select doc_id, w, count(*) as n from words group by 1, 2),
        lengths as (select doc_id, sum(n) as length from counts group by 1),
        terms as (select w, count(*) as df from counts group by 1),
        sizes as (select (select count(*) from documents)::double as docs, (select count(*) from words) / (select count(*) from documents)::double as mean),
        scores as (
            select q.doc_id as query_id, d.doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * length / mean))) as score
            from counts q join counts d on q.w = d.w and q.doc_id <> d.doc_id join terms on terms.w = q.w join lengths on lengths.doc_id = d.doc_id, sizes
            where q.doc_id % 100 = 0 group by 1, 2
        ),
        ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id)::int as rank from scores)
        select query_id, rank, doc_id, round(score, 6) as score from ranked where rank <= 10
    """,
    "op11_lattice_dedup": """
        with recursive vectors as (
            select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size
            from (select vec_id, embedding::double[] as v from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
        ),
        links as (select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and a.size > 0 and b.size > 0 and len(a.v) = len(b.v) where list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.95),
        reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
        lowest as (select a, min(b) as b from reach group by a),
        counts as (select a, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(b, vec_id)) as component_id, vec_id <= coalesce(b, vec_id) as kept
        from embeddings left join lowest on lowest.a = vec_id left join counts on counts.a = vec_id
    """,
    "op12_merkle_manifest": f"""
        with recursive {_CRCS},
        fields as (select *, {_FOLD.format(x="text")} as folded from documents),
        said as (
            select doc_id, lang, t, {" || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))} as head,
                coalesce(strlen(text) || ':' || text, '-') as body, coalesce(strlen(folded) || ':' || folded, '-') as changed from fields, crcs
        ),
        hashed as (
            select doc_id, lang, sha256(head || body) as leaf, case when {_CRC.format(x="doc_id::varchar")} % 3 = 0 then sha256(head || changed) end as tampered from said
        ),
        placed as (select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as pos from hashed),
        own_leaves as (select lang as g, pos, leaf as h from placed),
        {_sides("own", "partition by g")},
        top_leaves as (select null as g, row_number() over (order by g nulls first) - 1 as pos, h, g as lang from own_roots),
        {_sides("top", "")},
        steps as (
            select doc_id, leaf, tampered, subs.h as subroot, subs.pos as place, own.level, before, after from placed
            join top_leaves subs on subs.lang is not distinct from placed.lang join own_sides own on own.g is not distinct from placed.lang and own.pos = placed.pos
            union all
            select doc_id, leaf, tampered, subs.h, subs.pos, 100 + top.level, before, after from placed join top_leaves subs on subs.lang is not distinct from placed.lang join top_sides top on top.pos = subs.pos
        ),
        proofs as (
            select doc_id, leaf, tampered, subroot, sha256(string_agg(before || after, '' order by level)) as proof_sha256, list(struct_pack(b := before, a := after) order by level) as proof
            from steps group by doc_id, leaf, tampered, subroot
        ),
        ends as (
            select *, list_reduce(list_transform(proof, lambda x: struct_pack(b := x.b, a := x.a)), lambda h, x: struct_pack(b := sha256(x.b || h.b || x.a), a := ''), struct_pack(b := coalesce(tampered, leaf), a := '')).b as folded_root from proofs
        )
        select doc_id, leaf, subroot, top_roots.h as root, proof_sha256, folded_root, folded_root = top_roots.h as verified from ends, top_roots
    """,
    "op13_spelling": f"""
        with recursive {_CRCS},
        runs as (select doc_id, {_FOLD.format(x="unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+'))")} as run from documents),
        counted as (select doc_id, run, doc_id || ':' || run as x, count(*) as n from runs where length(run) >= 7 group by all),
        hashed as (select run, n, coalesce({_CRC.format(x="x")}, 1) as h from counted, crcs),
        spoilt as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
        words as (select word, sum(n)::bigint as n from spoilt where length(word) >= 7 group by word having sum(n) >= 2),
        cuts as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
        near as (
            select distinct a.word, b.word as other, b.n from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
            union select cuts.word, words.word, words.n from cuts join words on words.word = cuts.rest
            union select words.word, cuts.word, cuts.n from cuts join words on words.word = cuts.rest
        ),
        best as (select word, count(*) as n_near, min_by(other, (-n, other)) as other, max(n) as form_n from near group by word),
        forms as (select words.word, words.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 10 * n then other end as form, case when form_n >= 10 * n then form_n end as form_n from words left join best using (word)),
        chain(word, root) as (select word, form from forms where form is not null union all select chain.word, form from chain join forms on forms.word = chain.root where form is not null),
        ends as (select chain.word, root from chain join forms on forms.word = chain.root where form is null)
        select forms.word, form, coalesce(root, forms.word) as root, n, n_near, form_n from forms left join ends on ends.word = forms.word
    """,
}
