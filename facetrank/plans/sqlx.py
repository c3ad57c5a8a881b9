"""SQL text helpers for the DuckDB oracle (mirrors of functions.text)."""

from __future__ import annotations

from ..functions import fixed
from ..functions.fixed import TAG_MAP
from ..sources.fixtures import FEATURE_NOTES, REVIEW_NOTES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def decode(x: str) -> str:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    return x


def any_kw(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(coalesce({x}, 'nan'), {lit(w)})" for w in words) + ")"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce(CAST({x} AS VARCHAR), 'nan'), '[^0-9]', '', 'g')"


def tag_value(x: str, tag: str) -> str:
    t = f"coalesce({x}, 'nan')"
    return (f"CASE WHEN contains({t}, {lit('<' + tag + '>')}) THEN "
            f"{strip(f'regexp_extract({t}, {lit(f'<{tag}>([^<]*)')}, 1)')} ELSE 'None' END")


def str_list(items: list[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


TAGS_LIST = str_list([t for t, _ in TAG_MAP])

ACTS = """
acts AS (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS hall_id,
                CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'stay' WHEN 'purchase' THEN 'like'
                                WHEN 'signup' THEN 'survey' ELSE 'none' END AS action,
                value AS stay_time FROM events)"""

NVEC = "(SELECT count(*) FROM embeddings)"

USERS = f"""{ACTS},
first_ev AS (SELECT user_id, arg_min(hall_id, event_id) AS anchor FROM acts GROUP BY user_id),
users AS (SELECT f.user_id, p.p_brand AS location, p.p_type AS hall_type, p.p_retailprice AS max_price,
                 [{TAGS_LIST}[((f.user_id + 0) % 13) + 1], {TAGS_LIST}[((f.user_id + 5) % 13) + 1],
                  {TAGS_LIST}[((f.user_id + 10) % 13) + 1]] AS selected_tags,
                 p.p_name AS raw_query, f.user_id % {NVEC} AS query_vec_id
          FROM first_ev f JOIN part p ON p.p_partkey = f.anchor)"""

HALLS = """
halls AS (SELECT p_partkey AS id, p_name AS name, p_brand AS location, p_type AS hall_type,
                 p_retailprice AS price, p_size AS size FROM part)"""


def score_col(f: str) -> str:
    return f.replace("feat_", "", 1) + "_score"


def note_of(notes: list[str], salt: str, key: str) -> str:
    """Mirror of ``fixtures.note_of``."""
    return f"({str_list(notes)})[(CAST(('0x' || substr(md5('{salt}:' || {key}), 1, 4)) AS INTEGER) % {len(notes)}) + 1]"


NOTED = f"noted AS (SELECT * REPLACE (text || {note_of(REVIEW_NOTES, 'd', 'CAST(doc_id AS VARCHAR)')} AS text) FROM documents)"


def halls_wide(features: list[str], name: str = "hw") -> str:
    cols = []
    for i, f in enumerate(features):
        ph = f"CAST(('0x' || substr(md5('p:' || CAST(id AS VARCHAR) || ':{i}'), 1, 4)) AS INTEGER)"
        present = f"({ph} % 3) <> 0"
        note = note_of(FEATURE_NOTES, "n", f"CAST(id AS VARCHAR) || ':{i}'")
        cols.append(f"CASE WHEN {present} THEN concat_ws(' ', name, lower(hall_type), nullif({note}, '')) END AS {f}")
        h = f"CAST(('0x' || substr(md5('q:' || CAST(id AS VARCHAR) || ':' || CAST(size AS VARCHAR) || ':{i}'), 1, 4)) AS INTEGER)"
        cols.append(f"CASE WHEN {present} THEN CAST(1 + ({h} % 5) AS INTEGER) END AS {score_col(f)}")
    return f"{name} AS (SELECT *, {', '.join(cols)} FROM halls)"


def hall_long(features: list[str], wide: str = "hw", name: str = "hf") -> str:
    parts = [f"SELECT id, {lit(f)} AS feature, {i} AS fidx, {f} AS text, {score_col(f)} AS score, "
             f"(id * 13 + {i}) % {NVEC} AS vec_id FROM {wide} WHERE {f} IS NOT NULL"
             for i, f in enumerate(features)]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


BOILER = lit(fixed.BOILERPLATE)
