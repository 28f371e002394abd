"""SQL counterparts of the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '{_WS}'), lambda w : w <> ''))"


def _category(value: str) -> str:
    return f"lower(trim(regexp_replace({value}, '{_WS}', ' ', 'g')))"


def _key(field: str) -> str:
    return rf"regexp_replace(lower(coalesce({field}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"


def _copies(source: str, rows: str, id_col: str, fields: list[str]) -> str:
    keys = ", ".join(_key(f) for f in fields)
    return f"select '{source}' as source_table, {id_col} as id, min({id_col}) over (partition by {keys}) as kept_id from {rows}"


_GROUPS = (
    _copies("chunks", "chunks", "chunk_row", ["source_title", "text"])
    + " union all "
    + _copies(
        "chunk_payloads",
        "(select payload_id, " + ", ".join(f"payload ->> '$.{f}' as {f}" for f in ("source_title", "section", "text", "lang")) + " from chunk_payloads where json_valid(payload))",
        "payload_id",
        ["source_title", "section", "text", "lang"],
    )
)

_TARGETS = (
    "with d as (select distinct qid, 'gender' as attribute, " + _category("gender") + " as k from demographics"
    " union select distinct qid, 'country', " + _category("country") + " from demographics),"
    " t as (select plan_id, attribute, category, " + _category("category") + " as k,"
    " greatest(coalesce(min_count, 0), cast(ceil(round(target_share * sample_size, 6)) as bigint)) as required from sample_targets),"
    " c as (select t.plan_id, t.attribute, t.category, t.required, count(d.qid) as available"
    " from t left join d on d.attribute = t.attribute and d.k = t.k group by all) "
)

SQL: dict[str, str] = {
    "p1_found": f"""
        with r as (select distinct _id, context from records),
        p as (select _id, unnest(context) as c, generate_subscripts(context, 1) - 1 as para_no from r),
        s as (select _id, para_no, unnest(c.sentences) as s, generate_subscripts(c.sentences, 1) - 1 as sent_no from p),
        n as (select _id, para_no, sent_no, {_words("s")} as n from s where s is not null)
        select distinct 'paragraph' as item_kind, _id as item_key, cast(para_no as int) as para_no, -1 as sent_no
        from n group by _id, n.para_no having sum(n) > 512
        union select 'sentence', _id, cast(para_no as int), cast(sent_no as int) from n where n > 512
        union select 'chunk', cast(chunk_row as varchar), -1, -1 from chunks where {_words("text")} > 512""",
    "p2_found": f"select source_table, kept_id, id as copy_id from ({_GROUPS}) where id <> kept_id",
    "p2_counts": f"select source_table, kept_id, count(*) as n_copies from ({_GROUPS}) group by all",
    "p3_found": _TARGETS + "select plan_id, category from c where available < required",
    "p6_found": "select doc_id from documents where octet_length(encode(text)) + 1 > 2048",
}
