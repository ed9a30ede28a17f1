"""Common table expressions for the independent SQL checks (ANSI dialect)."""

from __future__ import annotations

from haulmark import fixed_values as fv


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


SPACES = text(fv.SPACE_CHARACTERS)


def strip(expr: str) -> str:
    return f"trim({expr}, {SPACES})"


def is_header(line: str) -> str:
    tests = [
        r"^#{1,4}\s+\S",
        r"^[A-Z][A-Z\s\-]{4,}$",
        r"^\d+\.\d*\s+[A-Z]",
        r"(?i)^(Section|Article|Part|Chapter)\s+\d+",
        r"^[A-Z][a-z].{10,}:$",
    ]
    return "(" + " OR ".join(f"regexp_matches({line}, {text(t)})" for t in tests) + ")"


def windows(expr: str, size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"CASE WHEN length({expr}) <= {size} THEN [{expr}] ELSE "
        f"[substring({expr}, CAST(k * {step} + 1 AS BIGINT), {size}) FOR k IN "
        f"range(0, CAST(ceil((length({expr}) - {size}) / {step}.0) AS BIGINT) + 1)] END"
    )


SECTIONS = {
    "doc_lines": """
        SELECT doc_id, category, source_path, unnest(string_split(parsed_text, chr(10))) AS line,
               generate_subscripts(string_split(parsed_text, chr(10)), 1) AS ln
        FROM parsed_documents WHERE regexp_matches(parsed_text, '\\S')""",
    "doc_parts": f"""
        SELECT *, sum(CASE WHEN ln > 1 AND {is_header('bare')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS part
        FROM (SELECT *, {strip('line')} AS bare FROM doc_lines)""",
    "doc_sections": """
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS section_no
        FROM (SELECT doc_id, category, source_path, part, string_agg(line, chr(10) ORDER BY ln) AS section_text
              FROM doc_parts GROUP BY doc_id, category, source_path, part)
        WHERE regexp_matches(section_text, '\\S')""",
}

CHUNKS = {
    **SECTIONS,
    "parent_pieces": f"""
        SELECT doc_id, category, source_path, section_no, unnest(w) AS piece, generate_subscripts(w, 1) - 1 AS wn
        FROM (SELECT *, {windows('section_text', 2500, 50)} AS w FROM doc_sections)""",
    "parent_chunks": f"""
        SELECT concat('P-', doc_id, '-', section_no, '-', wn) AS chunk_id, {strip('piece')} AS chunk_text, doc_id, category, source_path,
               CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY section_no, wn) - length(piece) AS BIGINT) AS char_start,
               CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY section_no, wn) AS BIGINT) AS char_end
        FROM parent_pieces""",
    "child_pieces": f"""
        SELECT *, unnest(w) AS piece, generate_subscripts(w, 1) - 1 AS cn
        FROM (SELECT *, {windows('chunk_text', 600, 100)} AS w FROM parent_chunks)""",
    "chunks": f"""
        SELECT chunk_id, NULL AS parent_id, 'parent' AS chunk_type, chunk_text, doc_id, category, source_path, char_start, char_end FROM parent_chunks
        UNION ALL
        SELECT concat('C-', chunk_id, '-', cn), chunk_id, 'child', {strip('piece')}, doc_id, category, source_path,
               char_start + cn * 500, char_start + cn * 500 + length(piece) FROM child_pieces""",
    "child_corpus": "SELECT chunk_id AS ckey, chunk_text AS body, category FROM chunks WHERE chunk_type = 'child'",
}

TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_-]+')"


def bm25(corpus: str, queries: str, n: int, name: str = "ranked", allowed: bool = False) -> dict[str, str]:
    """Ranking of ``corpus`` (ckey, body, category) for ``queries`` (query_id, question[, role])."""
    visible = (
        "AND (r.role IN (SELECT role FROM role_policy WHERE category = 'all') "
        "OR EXISTS (SELECT 1 FROM role_policy p WHERE p.role = r.role AND p.category = d.category))"
        if allowed
        else ""
    )
    return {
        f"{name}_tok": f"SELECT ckey, unnest({TERMS.format('body')}) AS term FROM {corpus}",
        f"{name}_post": f"SELECT ckey, term, count(*) AS tf FROM {name}_tok GROUP BY ckey, term",
        f"{name}_len": f"SELECT ckey, category, length({TERMS.format('body')}) AS dl FROM {corpus}",
        f"{name}_stat": f"SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_len",
        f"{name}_df": f"SELECT term, count(*) AS df FROM {name}_post GROUP BY term",
        f"{name}_qt": f"SELECT DISTINCT query_id, {'role,' if allowed else ''} unnest({TERMS.format('question')}) AS term FROM {queries}",
        f"{name}_score": f"""
            SELECT r.query_id, p.ckey, round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * (p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.dl / s.avgdl)))), 4) AS score
            FROM {name}_qt r JOIN {name}_post p ON r.term = p.term JOIN {name}_df f ON f.term = p.term
            JOIN {name}_len d ON d.ckey = p.ckey CROSS JOIN {name}_stat s
            WHERE TRUE {visible}
            GROUP BY r.query_id, p.ckey""",
        name: f"""
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ckey) AS rank FROM {name}_score)
            WHERE rank <= {n}""",
    }


ROLE_POLICY = {
    "role_policy": "SELECT * FROM (VALUES "
    + ", ".join(f"('{r}', {text(c)})" for r, cs in fv.ROLE_CATEGORIES.items() for c in cs)
    + ") AS t(role, category)"
}


def contains_any(expr: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(n)})" for n in needles) + ")"


def intent(expr: str) -> str:
    return (
        f"CASE WHEN regexp_matches({expr}, {text(fv.REFERENCE_ID)}) THEN 'keyword' "
        f"WHEN {contains_any(f'lower({expr})', fv.SQL_KEYWORDS)} THEN 'sql' ELSE 'hybrid' END"
    )


def guardrails() -> dict[str, str]:
    """The five fixed rules as a chain of common table expressions over ``answers``."""
    block1, block2, redact, append, cite = fv.GUARDRAIL_RULES
    topics = lambda names: [n.replace("_", " ") for n in names]
    b1 = contains_any("lower(answer)", [p.lower() for p in block1["trigger_phrases"]])
    b2 = contains_any("lower(answer)", topics(block2["prohibited_topics"]))
    steps = {
        "g0": f"""SELECT answer_id, answer, {b1} AS b1, NOT {b1} AND {b2} AS b2, {b1} OR {b2} AS blocked FROM answers""",
    }
    previous, col, flags = "g0", "answer", []
    for i, p in enumerate(redact["patterns"]):
        steps[f"g{i + 1}"] = (
            f"SELECT *, NOT blocked AND regexp_matches({col}, {text(p['regex'])}) AS r{i}, "
            f"regexp_replace({col}, {text(p['regex'])}, {text(p['replacement'])}, 'g') AS t{i} FROM {previous}"
        )
        previous, col = f"g{i + 1}", f"t{i}"
        flags.append((f"r{i}", p["name"]))
    disclaimer = append["disclaimer"]
    steps["ga"] = (
        f"SELECT *, NOT blocked AND {contains_any(f'lower({col})', topics(append['trigger_topics']))} "
        f"AND NOT contains({col}, {text(disclaimer)}) AS a1 FROM {previous}"
    )
    steps["gb"] = f"SELECT *, CASE WHEN a1 THEN {col} || {text(chr(10) * 2 + disclaimer)} ELSE {col} END AS ta FROM ga"
    cited = " OR ".join(f"regexp_matches(ta, {text(p)})" for p in fv.CITATION_PATTERNS)
    steps["gc"] = f"SELECT *, NOT blocked AND NOT ({cited}) AS c1 FROM gb"
    names = ", ".join(f"CASE WHEN {f} THEN '{n}' END" for f, n in flags)
    any_redacted = "(" + " OR ".join(f for f, _ in flags) + ")"
    steps["guarded"] = f"""
        SELECT answer_id, blocked,
               CASE WHEN b1 THEN {text(block1['blocked_message'])} WHEN b2 THEN {text(block2['blocked_message'])}
                    WHEN c1 THEN ta || {text(chr(10) * 2 + cite['reminder'])} ELSE ta END AS answer,
               CASE WHEN blocked THEN '' ELSE concat_ws('|', {names}) END AS redacted_items,
               concat_ws('|', CASE WHEN b1 THEN 'BLOCKED by {block1['name']}' END, CASE WHEN b2 THEN 'BLOCKED by {block2['name']}' END,
                   CASE WHEN {any_redacted} THEN concat('REDACTED by {redact['name']}: [''', concat_ws(''', ''', {names}), ''']') END,
                   CASE WHEN a1 THEN 'APPENDED by {append['name']}' END, CASE WHEN c1 THEN 'CITATION REMINDER by {cite['name']}' END) AS applied_rules,
               CASE WHEN blocked THEN 'BLOCK' WHEN {any_redacted} THEN 'REDACT' WHEN a1 OR c1 THEN 'APPEND' ELSE 'PASS' END AS action
        FROM gc"""
    return steps
