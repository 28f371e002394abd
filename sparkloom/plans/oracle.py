"""SQL counterparts (DuckDB) of the catalogue's queries."""

from __future__ import annotations

import unicodedata

from ..functions import text as S
from ..operators.metrics import poisson_marks

SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACES}]"
ASCII = r"'^[\x00-\x7f]*$'"
EVERY = 100


def q(text: str) -> str:
    return text.replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), lambda w : w <> '')"


def qids(x: str) -> str:
    return f"list_transform(list_filter(string_split(coalesce({x}, ''), '_'), lambda q : starts_with(q, 'Q')), lambda q : trim(q))"


def _compatible() -> str:
    """The characters that NFKD takes apart, as a SQL map; Korean syllables, which follow a formula, and
    the CJK compatibility ideographs stay as they are."""
    apart = {c: t for c in map(chr, range(0x80, 0xFFFF)) if not 0xAC00 <= ord(c) <= 0xFAFF and (t := unicodedata.normalize("NFKD", c)) != c}
    quoted = lambda items: ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    return f"map([{quoted(apart)}], [{quoted(apart.values())}])"


#: The map stands once in a query, beside the rows that need it.
NFKD = f"nfkd as materialized (select {_compatible()} as apart)"


def decomposed(x: str) -> str:
    """NFKD of a text, letter by letter; texts in ASCII as they are."""
    return f"case when regexp_matches({x}, {ASCII}) then {x} else (select array_to_string(list_transform(string_split({x}, ''), lambda c : coalesce(apart[c], c)), '') from nfkd) end"


def bare(x: str) -> str:
    """What normalising leaves of a decomposed text. What is no letter or digit is doubled first, so that
    neighbouring articles do not share it; white space and punctuation go anyway."""
    doubled = rf"regexp_replace({x}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace({doubled}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g'),"
        rf" '[!-/:-@\[-`{{-~]', '', 'g'), '{WS}+', ' ', 'g'))"
    )


def token_f1(p: str, g: str) -> str:
    a, b = words(p), words(g)
    common = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return (
        f"case when len({a}) = 0 or len({b}) = 0 then cast(len({a}) = len({b}) as double) when {common} = 0 then 0.0"
        f" else 2.0 * ({common} / len({a})) * ({common} / len({b})) / ({common} / len({a}) + {common} / len({b})) end"
    )


def safe(x: str) -> str:
    return f"substr(translate({x}, ' /', '__'), 1, 80)"


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(1, len({x}) - 2) + 1), lambda i : substr({x}, i, 3)))"


RECORDS = "r as (select * from (select *, row_number() over (partition by _id order by loaded_at desc) as rn from records) where rn = 1)"
TRIPLES = (
    f"t as (select * from (select triple_id, {strip('subject')} as subject, {strip('relation')} as relation, {strip('obj')} as obj,"
    " coalesce(source_chunk_id, '') as source_chunk_id, confidence from triples)"
    " where subject <> '' and relation <> '' and obj <> '' and lower(subject) <> lower(obj))"
)
MENTIONS = (
    TRIPLES + ", m as (select distinct source_chunk_id as chunk_id, entity from"
    " (select source_chunk_id, unnest([subject, obj]) as entity from t where source_chunk_id <> ''))"
)
EDGES = MENTIONS + ", e as (select distinct * from (select subject as a, obj as b from t union all select obj, subject from t) where a <> b)"
EVIDENCE = (
    RECORDS + f", ev as (select * from (select _id as question_id, o - 1 as ord, {strip('x[1]')} as subject, {strip('x[2]')} as relation, {strip('x[3]')} as obj from"
    " (select _id, unnest(evidences) as x, generate_subscripts(evidences, 1) as o from r) where len(x) >= 3)"
    " where subject <> '' and relation <> '' and obj <> '' and lower(subject) <> lower(obj))"
)
PEOPLE = (
    f"people as (select qid, min(g) filter (g <> '') as gender, min(geo_group) as geo_group from"
    f" (select qid, lower({strip('gender')}) as g, geo_group from demographics) group by qid)"
)
SEEDS = (
    f"seeds as (select query_id, c as chunk_id, 1.0 / pos as score from (select pred_id as query_id, unnest(retrieved_chunk_ids) as c,"
    f" generate_subscripts(retrieved_chunk_ids, 1) as pos from predictions where pred_id % {EVERY} = 0))"
)
BFS = (
    EDGES + ", " + SEEDS + """,
    c0 as (select query_id, chunk_id, max(score) as score from seeds group by all),
    v0 as (select query_id, entity, max(score) as score from c0 join m using (chunk_id) group by all),
    h1 as (select query_id, b as entity, max(score) * 0.5 as score from v0 join e on v0.entity = e.a
           where not exists (select 1 from v0 x where x.query_id = v0.query_id and x.entity = e.b) group by all),
    v1 as (select *, 0 as hop from v0 union all select *, 1 from h1),
    h2 as (select query_id, b as entity, max(score) * 0.25 as score from h1 join e on h1.entity = e.a
           where not exists (select 1 from v1 x where x.query_id = h1.query_id and x.entity = e.b) group by all),
    v as (select * from v1 union all select *, 2 from h2),
    c as (select query_id, chunk_id, max(score) as score from (select * from c0 union all
          select query_id, chunk_id, score from v join m using (entity) where hop > 0) group by all)"""
)
RANKED = "ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from c)"
TAGS = (
    RECORDS + ", " + PEOPLE + f""",
    tq as (select distinct chunk_id, qid, gender, geo_group from (select distinct chunk_id, unnest(question_ids) as _id from chunks)
           join (select _id, unnest({qids('entity_ids')}) as qid from r) using (_id) join people using (qid)),
    tags as (select chunk_id, arg_min(gender, qid) filter (gender <> '') as gender, arg_min(geo_group, qid) filter (geo_group <> '') as geo_group
             from tq group by chunk_id)"""
)
SCORED = (
    NFKD + ", dc as (select *, lower(coalesce(answer, '')) as la, lower(gold_answer) as lg from predictions where gold_answer is not null),"
    f" nm as (select * exclude (la, lg), {bare(decomposed('la'))} as na, {bare(decomposed('lg'))} as ng from dc),"
    f" sc as (select *, cast(na = ng as double) as em, {token_f1('na', 'ng')} as f1 from nm)"
)
GROUPS = (
    SCORED + ", lg as (select experiment, em, f1, 'gender' as attribute, coalesce(gender, 'unknown') as grp from sc"
    " union all select experiment, em, f1, 'geo_group', coalesce(geo_group, 'unknown') from sc),"
    " gm as (select attribute, grp, avg(em) as em, avg(f1) as f1, count(*) as n from lg group by all)"
)
GOLD = (
    RECORDS + ", g as (select p.pred_id, coalesce(p.retrieved_chunk_ids, []) as ranked, p.gender, p.geo_group,"
    " list_distinct(list_transform(coalesce(r.supporting_facts, []), lambda x : 'doc_' || substr(replace(x.title, ' ', '_'), 1, 80) || '_0')) as gold"
    " from predictions p join r on p.id = r._id)"
)
RR = "coalesce(1.0 / list_min(list_filter(list_transform(range(1, len(list_slice(ranked, 1, {k})) + 1), lambda i : case when list_contains(gold, ranked[i]) then i end), lambda x : x is not null)), 0.0)"
RUNS = (
    SCORED + ", pr as (select experiment, id, arg_min(answer, pred_id) as answer, arg_min(f1, pred_id) as f1 from sc group by all),"
    " ab as (select a.id, a.answer as answer_a, a.f1 as a, b.answer as answer_b, b.f1 as b from pr a join pr b using (id)"
    " where a.experiment = (select min(experiment) from pr) and b.experiment = (select max(experiment) from pr))"
)
FORMS = (
    TRIPLES + ", mc as (select name, count(*) as n from (select unnest([subject, obj]) as name from t) group by 1),"
    f" fm as (select form, {grams('form')} as g, len({grams('form')}) as k from (select distinct lower(trim(name)) as form from mc)),"
    " sp as (select a.form as a, b.form as b, len(list_intersect(a.g, b.g)) / (a.k + b.k - len(list_intersect(a.g, b.g))) as similarity"
    " from fm a join fm b on a.form < b.form and least(a.k, b.k) >= 0.9 * greatest(a.k, b.k) - 1e-9"
    " where len(list_intersect(a.g, b.g)) >= 0.9 * (a.k + b.k - len(list_intersect(a.g, b.g))) - 1e-9)"
)
CLUSTERS = (
    "with recursive " + FORMS + ", ed as (select a, b from sp union all select b, a from sp),"
    " reach as (select a as node, b as other from ed union select reach.node, ed.b from reach join ed on reach.other = ed.a),"
    " roots as (select node, least(node, min(other)) as root from reach group by node),"
    " pl as (select mc.name, mc.n, coalesce(root, lower(trim(name))) as cluster from mc left join roots on node = lower(trim(name))),"
    " cl as (select name, n, first_value(name) over (partition by cluster order by n desc, name) as canonical from pl)"
)
CHUNKED = (
    RECORDS + ", pg as (select _id as question_id, o - 1 as para_no, p.title as source_title, list_filter(p.sentences, lambda x : x is not null) as ss,"
    " coalesce(list_contains(list_transform(coalesce(supporting_facts, []), lambda x : x.title), p.title), false) as supports"
    " from (select _id, supporting_facts, unnest(context) as p, generate_subscripts(context, 1) as o from r) where p.sentences is not null),"
    f" sn as (select question_id, para_no, unnest(ss) as s, generate_subscripts(ss, 1) as pos from pg), sw as (select *, len({words('s')}) as n from sn),"
    " fo as (select question_id, para_no, pos, s, n as open, 0 as idx from sw where pos = 1 union all"
    " select sw.question_id, sw.para_no, sw.pos, sw.s, case when open + n > 512 then n else open + n end, case when open + n > 512 then idx + 1 else idx end"
    " from fo join sw on sw.question_id = fo.question_id and sw.para_no = fo.para_no and sw.pos = fo.pos + 1),"
    f" ch as (select f.question_id, f.para_no, f.idx, 'doc_' || {safe("coalesce(any_value(source_title), '')")} || '_' || f.idx as chunk_id, any_value(source_title) as source_title,"
    " string_agg(s, ' ' order by pos) as text, any_value(supports) as supports from fo f join pg using (question_id, para_no) group by f.question_id, f.para_no, f.idx),"
    " qc as (select question_id, row_number() over (partition by question_id order by seen, chunk_id) - 1 as ord, chunk_id"
    " from (select question_id, chunk_id, min((para_no, idx)) as seen from ch group by 1, 2))"
)
EV_AFTER = EVIDENCE.removeprefix(RECORDS)
#: Clusters of the names in the records' own evidence.
EV_CLUSTERS = CLUSTERS.replace(TRIPLES, EVIDENCE + ", t as (select * from ev)")
TO_QID = f""" f as (select question_id, subject, row_number() over (partition by question_id order by min(ord)) as nth from ev group by 1, 2),
        i as (select _id as question_id, loaded_at, unnest(x) as qid, generate_subscripts(x, 1) as nth from (select _id, loaded_at, {qids('entity_ids')} as x from r)),
        nq as (select subject as name, arg_max(qid, (loaded_at, question_id)) as qid from f join i using (question_id, nth) group by 1)"""
LONG_RECORDS = (
    "select _id, coalesce(question_type, '') as question_type, coalesce(len(supporting_facts), 0) as n_supporting,"
    " coalesce(len(list_filter(evidences, lambda e : len(e) >= 3)), 0) as n_evidences, coalesce(len(context), 0) as n_paragraphs from r"
)
EUROPE = "(" + ", ".join(f"'{q(c)}'" for c in S.EUROPEAN) + ")"


def long(sql: str, category: str, attribute: str, metrics: list[str]) -> str:
    values = ", ".join(f"cast({m} as double)" for m in metrics)
    return f"select '{category}' as category, {attribute} as attribute, unnest({metrics}) as metric, unnest([{values}]) as value from ({sql})"


def weighed(step: str, chunks: str, n: int) -> str:
    """One hop of balancing: scores of ``step`` by the groups in ``chunks``."""
    return f"""k{n} as (select query_id, attr, grp, count(*) as n from {chunks} join lt using (chunk_id) group by all),
    s{n} as (select query_id, attr, sum(n) as total, count(*) as groups from k{n} group by all),
    w{n} as (select h.query_id, h.entity, sum(m * case when total is null then 1.0 when coalesce(n, 0) / total > 1.0 / greatest(groups, 2) then 0.8 else 1.0 / 0.8 end) / sum(m) as w
          from {step} h join oe using (entity) left join s{n} using (query_id, attr) left join k{n} using (query_id, attr, grp) group by all),
    a{n} as (select h.query_id, h.entity, h.score * coalesce(w, 1.0) as score from {step} h left join w{n} using (query_id, entity))"""


def demo(keys: str, source: str, skip: str = "") -> str:
    geo = f"case when geo_group <> 'unknown' then geo_group end" if skip else "geo_group"
    return f"""x as (select {keys}, qid, pos from (select {keys}, unnest({qids('entity_ids')}) as qid, generate_subscripts({qids('entity_ids')}, 1) as pos from {source})),
      y as (select {keys}, pos, gender, {geo} as geo from x join people using (qid)),
      z as (select {keys}, arg_min(gender, pos) filter (gender <> '') as gender, arg_min(geo, pos) filter (geo <> '') as geo_group from y group by {keys})
      select k.{keys}, z.gender, z.geo_group from (select distinct {keys} from {source}) k left join z using ({keys})"""


FILTERED = f"""{BFS}, {RANKED}, top as (select * from ranked where rank <= 20), nd as (select distinct query_id, entity from top join m using (chunk_id)),
        pa as (select distinct least(subject, obj) as a, greatest(subject, obj) as b from t where subject <> obj),
        ins as (select x.query_id, a, b from pa join nd x on x.entity = a join nd y on y.entity = b and y.query_id = x.query_id),
        qs as (select pred_id as query_id, coalesce(question, '') as question from predictions where pred_id % {EVERY} = 0),
        hits as (select query_id, entity from nd join qs using (query_id) where contains(lower(question), lower(entity)) or len(list_filter(regexp_split_to_array(lower(question), '[ \\t\\n\\r\\f\\x0b]+'),
          lambda w : len(list_intersect({grams('lower(trim(entity))')}, {grams('w')})) >= 0.9 * len(list_distinct(list_concat({grams('lower(trim(entity))')}, {grams('w')}))) - 1e-12)) > 0),
        j as (select top.*, (select count(*) from nd where nd.query_id = top.query_id) as nn, (select count(*) from ins where ins.query_id = top.query_id) as ne,
          (select count(*) from hits where hits.query_id = top.query_id) as nh, chunk_id in (select chunk_id from m) as has from top),
        k as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from j where nn < 2 or (ne = 0 and nh < 2) or has),
        fl as (select query_id, rank, chunk_id, score from k where rank <= 15)"""


SQL: dict[str, str] = {
    "records_parsed": f"with {RECORDS} {LONG_RECORDS}",
    "record_qids": f"with {RECORDS} select _id, generate_subscripts(x, 1) - 1 as pos, unnest(x) as qid from (select _id, {qids('entity_ids')} as x from r)",
    "supporting_titles": f"with {RECORDS} select distinct _id, unnest(supporting_facts).title as title from r",
    "paragraph_text": f"""with {RECORDS}, p as (select _id, generate_subscripts(context, 1) - 1 as pos, unnest(context) as p from r)
        select _id, pos, len(coalesce(array_to_string(p.sentences, ' '), '')) as n_chars, len({words("array_to_string(p.sentences, ' ')")}) as n_words from p where p.sentences is not null""",
    "evidence_triples": f"with {EVIDENCE} select * from ev",
    "safe_ids": f"select chunk_row, {safe('source_title')} as safe, 'doc_' || substr(replace(source_title, ' ', '_'), 1, 80) || '_0' as gold from chunks",
    "truncated_texts": f"""select chunk_row, md5(case when len({words('text')}) <= 64 then text else array_to_string(list_slice({words('text')}, 1, 64), ' ') end) as digest,
        len({words('text')}) as n_words from chunks""",
    "parsed_answers": rf"""with p as (select pred_id, {strip('raw_response')} as x from predictions),
        s as (select pred_id, x, regexp_extract(x, '(?i)(?:answer|ans)[{SPACES}:]+([^\n]+?)(?:\n|$)', 1) as marked, regexp_extract(x, '(?i)the answer is{WS}+([^\n]+?)(?:\.|$)', 1) as stated from p)
        select pred_id, case when marked <> '' then regexp_replace({strip('marked')}, '\.+$', '') when stated <> '' then {strip('stated')}
        else regexp_replace({strip("string_split(x, chr(10))[1]")}, '\.+$', '') end as parsed from s""",
    "rendered_prompts": f"""select pred_id, md5(case when coalesce(gold_answer, '') = '' then '{q(S.PROMPT_BARE)}' else '{q(S.PROMPT_HEAD)}' || gold_answer end
        || '{q(S.PROMPT_TAIL[0])}' || coalesce(question, '') || '{q(S.PROMPT_TAIL[1])}') as digest from predictions""",
    "geo_classes": f"""select case when country is null or country = '' then 'unknown' when country in {EUROPE} then 'european' else 'non_european' end as computed,
        geo_group, count(*) as n from demographics group by all""",
    "answer_scores": f"with {SCORED} select pred_id, em, round(f1, 6) as f1 from sc",
    "text_hashes": "select doc_id, substr(sha256(text), 1, 16) as hash from documents",
    "props_parsed": "select event_id, cast(props ->> '$.k' as bigint) as k from events",
    "uri_tails": """select case when qid is null then null when qid like '%7' then 'female' when qid like '%1' then 'male' else 'other' end as gender, count(*) as n
        from demographics group by all""",
    "chunk_corpus": f"""with recursive {CHUNKED} select chunk_id, arg_min_null(source_title, (question_id, para_no, idx)) as source_title, md5(arg_min(text, (question_id, para_no, idx))) as digest,
        count(distinct question_id) as n_questions, bool_or(supports) as is_supporting from ch group by 1""",
    "question_chunks": f"with recursive {CHUNKED} select question_id, ord, chunk_id from qc",
    "linked_triples": f"""with recursive {CHUNKED}{EV_AFTER} select question_id, count(*) as n, count(distinct coalesce(chunk_id, '')) as n_chunks from ev left join qc using (question_id) group by 1""",
    "chunk_lookup": """with x as (select chunk_id, arg_min(text, chunk_row) as text from chunks group by 1), p as (select pred_id, unnest(retrieved_chunk_ids) as chunk_id from predictions)
        select pred_id, count(*) as n, cast(sum(len(text)) as bigint) as n_chars from p join x using (chunk_id) where text is not null group by 1""",
    "triples_extract": f"with {TRIPLES} select triple_id, subject, relation, obj, source_chunk_id from t",
    "kg_nodes": f"with {TRIPLES} select distinct unnest([subject, obj]) as entity from t",
    "kg_related": f"with {TRIPLES} select subject, obj as object, count(*) as n, round(max(confidence), 6) as top from t group by all",
    "kg_mentions": f"with {MENTIONS} select * from m",
    "kg_summary": f"""with {MENTIONS}, a as (select count(distinct x) as num_entities from (select unnest([subject, obj]) as x from t)),
        b as (select count(*) as num_relations, count(distinct relation) as num_relation_types from t), c as (select count(distinct chunk_id) as num_chunks_mapped from m)
        select *, case when num_entities <= 1 then 0.0 else round(num_relations / (num_entities * (num_entities - 1)), 6) end as density from a, b, c""",
    "chunk_entities": f"with {MENTIONS} select chunk_id, count(*) as n, string_agg(entity, '|' order by entity) as entities from m group by 1",
    "entity_chunks": f"with {MENTIONS} select entity, chunk_id, count(*) over (partition by entity) as n from m",
    "neighbors_1hop": f"""with {EDGES} select distinct canonical_name as start, b as neighbor from canonical_entities join e on a = canonical_name where entity_id % {EVERY} = 0""",
    "neighbors_2hop": f"""with {EDGES}, s as (select canonical_name as start from canonical_entities where entity_id % {EVERY} = 0),
        n1 as (select distinct start, b from s join e on a = start), n2 as (select start, e.b from n1 join e on e.a = n1.b)
        select distinct start, b as neighbor from (select * from n1 union all select * from n2) where b <> start""",
    "induced_subgraph": f"""with {TRIPLES}, n as (select canonical_name as c from canonical_entities where kind in ('place', 'person'))
        select subject, relation, obj, source_chunk_id from t where subject in (select c from n) and obj in (select c from n)""",
    "edges_between": f"with {TRIPLES} select subject, obj, count(*) as n, count(distinct relation) as n_relations from t group by all having count(*) > 1",
    "index_overlap": f"""with {MENTIONS}, i as (select distinct chunk_id from chunks)
        select *, round(n_both / n_index, 6) as share from (select count(*) as n_index, count(*) filter (chunk_id in (select chunk_id from m)) as n_both from i)""",
    "ngram_jaccard_pairs": f"with {FORMS} select a, b, round(similarity, 6) as similarity from sp",
    "entity_clusters": f"{CLUSTERS} select name, canonical, n from cl",
    "cluster_count": f"{CLUSTERS} select count(distinct canonical) as n from cl",
    "normalised_triples": f"""{CLUSTERS}, o as (select triple_id, s.canonical as subject, x.canonical as obj from t join cl s on t.subject = s.name join cl x on t.obj = x.name)
        select * from o where subject <> obj""",
    "entity_to_qid": f"with {EVIDENCE}, {TO_QID} select name, qid from nq",
    "canonical_qids": f"""{EV_CLUSTERS}, {TO_QID}, mp as (select nq.name as "of", coalesce(canonical, nq.name) as canonical, qid from nq left join cl using (name)),
        bo as (select canonical as name, qid, "of" from mp union all select "of", qid, "of" from mp) select name, arg_max(qid, "of") as qid from bo group by 1""",
    "chunk_demographics": f"""with recursive {CHUNKED}{EV_AFTER}, {TO_QID}, {PEOPLE},
        lk as (select distinct qc.chunk_id, entity from (select question_id, unnest([subject, obj]) as entity from ev) join qc using (question_id)),
        jo as (select chunk_id, entity, gender, geo_group from lk left join nq on nq.name = entity left join people using (qid))
        select chunk_id, arg_min(gender, entity) filter (gender <> '') as gender, arg_min(geo_group, entity) filter (geo_group <> '') as geo_group from jo group by 1""",
    "prediction_demographics": f"with {PEOPLE}, {demo('pred_id', 'predictions')}",
    "question_demographics": f"with {RECORDS}, {PEOPLE}, {demo('_id', 'r', 'skip')}",
    "demographics_coverage": f"with {PEOPLE} select count(*) as n, count(gender) as with_gender, count(geo_group) as with_geo from people",
    "sample_priority": f"""with {RECORDS}, {PEOPLE}, k as (select _id, bool_or(gender is not null or coalesce(geo_group <> 'unknown', false)) as has_demo
        from (select _id, unnest({qids('entity_ids')}) as qid from r) join people using (qid) group by 1)
        select r._id, coalesce(has_demo, false) as has_demo from r left join k using (_id) order by has_demo desc, loaded_at, _id limit 100""",
    "dense_topk": f"""with x as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i : cast(a.embedding[i] as double) * cast(b.embedding[i] as double))) as s
        from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
        y as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank from x)
        select query_id, rank, vec_id, round(s, 6) as score from y where rank <= 10""",
    "dense_sweep": f"""with x as (select a.vec_id as query_id, b.vec_id, a.label = b.label as hit, a.label, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i : cast(a.embedding[i] as double) * cast(b.embedding[i] as double))) as s
        from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0),
        y as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) as rank from x),
        g as (select label, count(*) - 1 as n_gold from embeddings group by 1),
        p as (select query_id, k, n_gold, count(*) filter (hit) as hits, count(*) as n, min(rank) filter (hit) as first from y join g using (label), (select unnest([1, 3, 5, 10]) as k) where rank <= k group by all)
        select k, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, round(avg(hits / n_gold), 6) as recall, round(avg(hits / n), 6) as precision from p group by k""",
    "bm25_topk": rf"""with d as (select chunk_row as doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0b]+'), lambda w : w <> '') as w from chunks where text is not null),
        st as (select count(*) as n, avg(len(w)) as avgdl from d), po as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from d) group by all),
        rw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from po, st group by term, n), mn as (select avg(idf) as mean_idf from rw),
        wa as (select query_id, term, count(*) as qtf from (select pred_id as query_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(question, '')), '[ \t\n\r\f\x0b]+'), lambda w : w <> '')) as term
          from predictions where pred_id % {EVERY} = 0) group by all),
        sc as (select query_id, doc_id, round(sum((case when idf < 0 then 0.25 * mean_idf else idf end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf), 6) as score
          from po join rw using (term) join wa using (term), mn, st group by all),
        rk as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc) select query_id, rank, doc_id, score from rk where rank <= 10 and score > 0""",
    "bfs_expand_chunks": f"with {BFS}, {RANKED} select query_id, rank, chunk_id, round(score, 9) as score from ranked where rank <= 20",
    "bfs_expand_entities": f"with {BFS} select query_id, entity, round(score, 9) as score, hop from v",
    "fair_post_hoc": f"""with {BFS}, {RANKED}, {TAGS},
        x as (select ranked.*, case when tags.chunk_id is null then 'v:unknown' when gender is null then 'null' else 'v:' || gender end as grp from ranked left join tags using (chunk_id)),
        f as (select query_id, grp, min(rank) as first from x group by all), o as (select *, row_number() over (partition by query_id order by first) - 1 as nth, count(*) over (partition by query_id) as n from f),
        y as (select x.*, row_number() over (partition by x.query_id, x.grp order by rank) as place, 20 // n + case when nth < 20 % n then 1 else 0 end as quota from x join o using (query_id, grp))
        select query_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, chunk_id, round(score, 9) as score from y where place <= quota""",
    "fair_in_traversal": f"""with {BFS}, {TAGS},
        lt as (select chunk_id, 'gender' as attr, gender as grp from tags where gender is not null union all select chunk_id, 'geo_group', geo_group from tags where geo_group is not null),
        oe as (select entity, attr, grp, count(*) as m from m join lt using (chunk_id) group by all), {weighed('h1', 'c0', 1)},
        c1 as (select query_id, chunk_id, max(score) as score from (select * from c0 union all select query_id, chunk_id, score from a1 join m using (entity)) group by all),
        g2 as (select query_id, b as entity, max(score) * 0.25 as score from a1 join e on a1.entity = e.a
               where not exists (select 1 from v1 x where x.query_id = a1.query_id and x.entity = e.b) group by all), {weighed('g2', 'c1', 2)},
        c2 as (select query_id, chunk_id, round(max(score), 9) as score from (select * from c1 union all select query_id, chunk_id, score from a2 join m using (entity)) group by all),
        rk as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from c2)
        select query_id, rank, chunk_id, score from rk where rank <= 20""",
    "fair_constraint": f"""with recursive {BFS}, {RANKED}, {TAGS},
        x as (select query_id, rank, chunk_id, score, gender, geo_group from ranked left join tags using (chunk_id)),
        s as (select query_id, 0 as rank, cast(null as varchar) as chunk_id, cast(null as double) as score, false as took, cast([] as varchar[]) as gs, cast([] as varchar[]) as os, 0 as n from (select distinct query_id from x)
          union all select x.query_id, x.rank, x.chunk_id, x.score, ok, case when ok then list_append(gs, coalesce(gender, '')) else gs end, case when ok then list_append(os, coalesce(geo_group, '')) else os end,
            case when ok then n + 1 else n end from (select x.*, s.gs, s.os, s.n, s.n < 20 and not (gender is not null and (len(list_filter(s.gs, lambda v : v = gender)) + 1) / (s.n + 1) > 0.7)
              and not (geo_group is not null and (len(list_filter(s.os, lambda v : v = geo_group)) + 1) / (s.n + 1) > 0.7) as ok from s join x on x.query_id = s.query_id and x.rank = s.rank + 1 where s.n < 20) x)
        select query_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank, chunk_id, round(score, 9) as score from s where took""",
    "graph_filtered": f"with {FILTERED} select query_id, rank, chunk_id, round(score, 9) as score from fl",
    "edge_weights": f"""with {FILTERED}, wg as (select ins.query_id, ins.a, ins.b, coalesce(va.score, 0) + coalesce(vb.score, 0) as weight from ins
          left join v va on va.query_id = ins.query_id and va.entity = ins.a left join v vb on vb.query_id = ins.query_id and vb.entity = ins.b),
        bo as (select x.query_id, x.entity as a, y.entity as b from hits x join hits y on x.query_id = y.query_id and x.entity < y.entity)
        select query_id, a, b, round(coalesce(weight, 0) + case when bo.query_id is null then 0 else 2.0 end, 9) as weight from wg full join bo using (query_id, a, b)""",
    "retrieval_sizes": f"""with {FILTERED}, n as (select count(*) as n from predictions where pred_id % {EVERY} = 0),
        tx as (select chunk_id from (select chunk_id, arg_min(text, chunk_row) as text from chunks group by 1) where text is not null),
        fi as (select query_id, least(5, count(*)) as k from fl join tx using (chunk_id) group by 1)
        select round((select count(*) from seeds) / n, 6) as seed, round((select count(*) from top) / n, 6) as expanded, round((select count(*) from fl) / n, 6) as filtered,
        round((select sum(k) from fi) / n, 6) as final from n""",
    "accuracy_summary": f"with {SCORED} select round(avg(em), 6) as em, round(avg(f1), 6) as f1, count(*) as n from sc",
    "support_summary": f"""with {RECORDS}, b as (select list_distinct(p.supporting_titles) as p, list_distinct(list_transform(r.supporting_facts, lambda x : x.title)) as g from predictions p join r on p.id = r._id
        where len(p.supporting_titles) > 0 and len(r.supporting_facts) > 0)
        select round(avg(2.0 * len(list_intersect(p, g)) / (len(p) + len(g))), 6) as support_f1, count(*) as n from b""",
    "group_disparity": f"with {GROUPS} select attribute, grp, round(em, 6) as em, round(f1, 6) as f1, n from gm",
    "demographic_parity": f"with {GROUPS} select attribute, round(case when count(*) >= 2 then max(em) - min(em) else 0.0 end, 6) as parity_gap from gm group by 1",
    "equalized_odds": f"with {GROUPS} select attribute, grp, round(em, 6) as tpr, n from gm",
    "retrieval_sweep": f"""with {GOLD}, k as (select unnest([1, 3, 5, 10]) as k), x as (select k, ranked, gold, list_slice(ranked, 1, k) as top, {RR.format(k='k')} as rr from g, k where len(gold) > 0)
        select k, round(avg(rr), 6) as mrr, round(avg(len(list_intersect(list_distinct(top), gold)) / len(gold)), 6) as recall,
        round(avg(case when len(top) > 0 then len(list_intersect(list_distinct(top), gold)) / len(top) else 0.0 end), 6) as precision from x group by k""",
    "retrieval_fairness": f"""with {GOLD}, x as (select *, {RR.format(k='5')} as rr from g), y as (select rr, 'gender' as attribute, coalesce(gender, 'unknown') as grp from x
        union all select rr, 'geo_group', coalesce(geo_group, 'unknown') from x) select attribute, grp, round(avg(rr), 6) as mrr, count(*) as n from y group by all""",
    "bootstrap_ci": f"""with {SCORED}, h as (select em, g, md5(g || ':' || pred_id) as h from sc, (select unnest(range(250)) as g)),
        w as (select g * 4 + k as rep, em, list_sum(list_transform({list(poisson_marks())}, lambda m : cast(substr(h, 8 * k + 1, 8) >= m as int))) as w from h, (select unnest(range(4)) as k)),
        ms as (select rep, round(sum(w * em) / sum(w), 9) as m from w group by rep having sum(w) > 0), rk as (select m, row_number() over (order by m, rep) - 1 as rank from ms)
        select (select round(avg(em), 6) from sc) as mean, round(max(m) filter (rank = 25), 6) as lower, round(max(m) filter (rank = 974), 6) as upper from rk""",
    "permutation_test": f"""with {RUNS}, b as (select id, a - b as d from ab), h as (select d, g, md5(g || ':' || id) as h from b, (select unnest(range(32)) as g)),
        ms as (select g * 32 + k as rep, avg(case when substr(h, k + 1, 1) >= '8' then -d else d end) as m from h, (select unnest(range(32)) as k) where g * 32 + k < 1000 group by rep),
        o as (select avg(d) as observed, count(*) as n from b)
        select round(observed, 6) as observed, round(avg(cast(abs(round(m, 9)) >= abs(round(observed, 9)) as double)), 6) as p_value, n from ms, o group by observed, n""",
    "corpus_stats": f"""with {RECORDS}, x as ({LONG_RECORDS}) select count(*) as n, round(avg(n_paragraphs), 6) as paragraphs, round(avg(n_evidences), 6) as evidences,
        round(avg(cast(n_supporting > 0 as double)), 6) as supported from x""",
    "value_share": """with x as (select gender, count(*) as n from predictions group by 1) select gender, n, round(n / sum(n) over (), 6) as share,
        case when n / sum(n) over () < 0.85 then 'OK' else 'SKEWED' end as state from x""",
    "evidence_by_type": f"with {RECORDS}, x as ({LONG_RECORDS}) select question_type, round(avg(cast(n_evidences > 0 as double)), 6) as share, count(*) as n from x group by 1",
    "crosstab_margins": """with x as (select coalesce(gender, 'none') as gender, coalesce(geo_group, 'none') as geo_group from predictions)
        select coalesce(gender, 'All') as gender, coalesce(geo_group, 'All') as geo_group, count(*) as n from x group by cube (x.gender, x.geo_group)""",
    "pivot_counts": """select experiment, count(*) filter (geo_group = 'european') as european, count(*) filter (geo_group = 'non_european') as non_european,
        count(*) filter (geo_group = 'unknown') as unknown, count(*) filter (geo_group is null) as none from predictions group by 1""",
    "relation_counts": "select coalesce(relation, 'unknown') as relation, count(*) as n from triples group by 1 order by n desc, relation limit 20",
    "confidence_histogram": """with x as (select confidence as c, min(confidence) over () as lo, max(confidence) over () as hi from triples where confidence is not null)
        select cast(least(29, floor((c - lo) / (hi - lo) * 30)) as bigint) as bin, count(*) as n from x group by 1""",
    "melted_metrics": f"""with {SCORED} select experiment, 'em' as metric, round(avg(em), 6) as value from sc group by 1 union all select experiment, 'f1', round(avg(f1), 6) from sc group by 1""",
    "type_breakdown": f"""with {SCORED} select coalesce(question_type, 'unknown') as question_type, experiment, round(avg(em), 6) as em, round(avg(f1), 6) as f1, count(*) as n from sc group by 1, 2""",
    "run_comparison": f"""with {GROUPS}, a as (select experiment, attribute, grp, avg(em) as em, avg(f1) as f1 from lg group by all),
        b as (select experiment, attribute, case when count(*) >= 2 then max(em) - min(em) else 0 end as p, case when count(*) >= 2 then max(f1) - min(f1) else 0 end as d from a group by all)
        select experiment, coalesce(round(max(p) filter (attribute = 'gender'), 6), 0) as gender_parity, coalesce(round(max(d) filter (attribute = 'gender'), 6), 0) as gender_disparity,
        coalesce(round(max(p) filter (attribute = 'geo_group'), 6), 0) as geo_group_parity, coalesce(round(max(d) filter (attribute = 'geo_group'), 6), 0) as geo_group_disparity from b group by 1""",
    "fairness_tradeoff": f"""with {GROUPS}, a as (select experiment, attribute, grp, avg(em) as em from lg group by all),
        b as (select experiment, attribute, case when count(*) >= 2 then max(em) - min(em) else 0 end as p from a group by all)
        select experiment, (select round(avg(f1), 6) from sc where sc.experiment = b.experiment) as f1, round(max(p), 6) as parity from b group by 1""",
    "accuracy_listing": f"with {GROUPS} select attribute || ':' || grp as attribute, round(em, 6) as em, cast(n as double) as n from gm",
    "changed_answers": f"with {RUNS} select count(*) as n, count(*) filter (answer_a is distinct from answer_b) as changed from ab",
    "first_per_type": f"with {RECORDS} select coalesce(question_type, '') as question_type, arg_min(_id, (loaded_at, _id)) as _id from r group by 1",
    "random_three": "select pred_id, md5('42:' || pred_id) as h from predictions order by h limit 3",
}

SQL["evaluate_all"] = " union all ".join(
    (
        long(SQL["accuracy_summary"], "accuracy", "''", ["em", "f1", "n"]),
        long(SQL["retrieval_sweep"], "retrieval", "cast(k as varchar)", ["mrr", "recall", "precision"]),
        long(SQL["group_disparity"], "fairness", "attribute || ':' || grp", ["em", "f1", "n"]),
        long(SQL["demographic_parity"], "parity", "attribute", ["parity_gap"]),
        long(SQL["retrieval_fairness"], "retrieval_fairness", "attribute || ':' || grp", ["mrr", "n"]),
    )
)
