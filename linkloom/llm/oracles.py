"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .chat import CONTROLS, FOLLOWS, OTHER_AFTER, OTHER_BEFORE, OTHER_MIDDLE, TEMPLATE
from .common import WORD_RE


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(x: str) -> str:
    """Length of x once it is escaped."""
    counts = " + ".join(f"(length({x}) - length(replace({x}, {_q(c)}, ''))) // {len(c)}" for c in CONTROLS)
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + {counts})"


def chat() -> str:
    around = " ".join(f"WHEN {_q(r)} THEN {len(t.before) + len(t.after)}" for r, t in TEMPLATE.items())
    learnt = ", ".join(_q(r) for r, t in TEMPLATE.items() if t.loss)
    follows = " OR ".join(f"(state = {_q(s)} AND role IN ({', '.join(map(_q, rs))}))" for s, rs in FOLLOWS.items())
    known = ", ".join(_q(s) for s in FOLLOWS if s)
    extra = _q("</s>[INST] ok [/INST]")
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', {extra}), (-7, 1, 'assistant', {extra})),
    s AS (SELECT *, coalesce(last_value(CASE WHEN role IN ({known}) THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS state FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role IN ({learnt})), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN ({learnt})), '')) AS loss_sha256,
        sum({_escaped('text')} + CASE role {around} ELSE {len(OTHER_BEFORE + OTHER_MIDDLE + OTHER_AFTER)} + {_escaped('role')} END)::BIGINT AS formatted_chars,
        bool_and({follows}) AS valid
    FROM s GROUP BY conv_id"""


def substrings(width: int = 35) -> str:
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_q(WORD_RE)}) AS w FROM documents),
    p AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + {width - 1}), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {width - 2}))) AS i FROM d)),
    again AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, i + o AS i FROM p JOIN again ON again.k = p.k CROSS JOIN range({width}) r(o)),
    each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text, count(*) AS n FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY 1)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def vectors(threshold: float = 0.93) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {threshold}::DOUBLE),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
    SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept FROM embeddings e
    JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = e.vec_id"""


ORACLES = {"op2_embedding_near_dedup": vectors(), "op4_chat_format": chat(), "op5_substring_dedup": substrings()}
