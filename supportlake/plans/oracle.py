"""DuckDB SQL spellings of the native Column functions.

Used only to write the independent oracle queries in ``__spark_entry__``.
They follow the same definitions (same fixed values) in another engine's
dialect: RE2 regex without ``(?U)``, ``'g'`` flag for global replace,
1-based lists.
"""

from __future__ import annotations

from supportlake import fixed
from supportlake.functions.text import PY_WHITESPACE, regex_escape

# the references that the tables and fixture rows hold, each also without its
# semicolon; ``&amp`` last (the library decodes all HTML references natively)
ENTITY_CHAIN = [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&copy;?", "\xa9"),
                ("&middot;?", "\xb7"), ("&amp;?", "&")]
from supportlake.taxonomy import keyword_vocabulary, keywords_by_intent


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def nn(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


def py_pattern(p: str) -> str:
    return p.replace(r"\s", PY_WHITESPACE)


def clean(x: str, brand: bool) -> str:
    t = nn(x)
    for ent, ch in ENTITY_CHAIN:
        t = f"regexp_replace({t}, {lit(ent)}, {lit(ch)}, 'g')"
    t = f"replace({t}, {lit(fixed.REPLACEMENT_CHAR)}, {lit(fixed.REPLACEMENT_CHAR_SUB)})"
    if brand:
        t = f"regexp_replace({t}, {lit(py_pattern(fixed.SIGNATURE_PATTERN))}, '')"
    t = f"regexp_replace({t}, {lit(fixed.MENTION_PATTERN)}, '', 'g')"
    return f"trim(regexp_replace({t}, {lit(PY_WHITESPACE + '+')}, ' ', 'g'))"


def ascii_ratio(x: str) -> str:
    t = nn(x)
    return f"(length(regexp_replace({t}, '[^\\x00-\\x7F]', '', 'g')) / greatest(length({t}), 1))"


def stopword_hits(x: str) -> str:
    return (f"len(list_intersect(list_distinct(regexp_extract_all(lower({nn(x)}), '[a-zA-Z]+')), "
            f"{str_list(fixed.ENGLISH_STOPWORDS)}))")


def is_english(x: str) -> str:
    t = nn(x)
    strip = f"regexp_replace({t}, {lit('^' + PY_WHITESPACE + '+|' + PY_WHITESPACE + '+$')}, '', 'g')"
    return (f"(length({strip}) >= {fixed.ENGLISH_MIN_LENGTH} AND {ascii_ratio(x)} >= {fixed.ENGLISH_MIN_ASCII_RATIO} "
            f"AND {stopword_hits(x)} >= {fixed.ENGLISH_MIN_STOPWORDS})")


def links(x: str) -> str:
    return f"regexp_extract_all({nn(x)}, {lit(fixed.URL_PATTERN)})"


def links_str(x: str) -> str:
    return f"array_to_string({links(x)}, ';')"


def dm_flag(x: str) -> str:
    return f"regexp_matches({nn(x)}, {lit(fixed.DM_PATTERN.replace('(?i)', ''))}, 'i')"


def link_flag(x: str) -> str:
    return f"regexp_matches({nn(x)}, {lit(fixed.LINK_PATTERN.replace('(?i)', ''))}, 'i')"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({nn(x)}, {lit(PY_WHITESPACE + '+')}), lambda w: w <> ''))"


def keyword_count(low: str, kw: str) -> str:
    return f"len(regexp_extract_all({low}, {lit(chr(92) + 'b' + regex_escape(kw) + chr(92) + 'b')}))"


def intent_score(low: str, intent: str) -> str:
    terms = " + ".join(keyword_count(low, kw) for kw in keywords_by_intent()[intent])
    return f"CAST(({terms}) * {fixed.KEYWORD_WEIGHT} AS DOUBLE)"


def score_list(x: str) -> str:
    low = f"lower({nn(x)})"
    return "[" + ", ".join(intent_score(low, i) for i in fixed.INTENTS) + "]"


def best_intent(scores: str) -> str:
    """First intent holding the maximum (null when all scores are 0)."""
    return (f"CASE WHEN list_max({scores}) > 0 THEN "
            f"{str_list(fixed.INTENTS)}[list_position({scores}, list_max({scores}))] END")


def contains_any(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {lit(w)})" for w in words) + ")"


def gt_action(intent: str, x: str) -> tuple[str, str]:
    """(action CASE, reason CASE) of the ground-truth policy."""
    low = f"lower({nn(x)})"
    act, why = [], []
    act.append(f"WHEN {contains_any(low, fixed.GT_THREAT_WORDS)} THEN {lit(fixed.ESCALATE)}")
    why.append(f"WHEN {contains_any(low, fixed.GT_THREAT_WORDS)} THEN {lit(fixed.GT_THREAT_REASON)}")
    for name, reason in fixed.GT_ALWAYS_ESCALATE:
        act.append(f"WHEN {intent} = {lit(name)} THEN {lit(fixed.ESCALATE)}")
        why.append(f"WHEN {intent} = {lit(name)} THEN {lit(reason)}")
    for name, words, er, ar in fixed.GT_INTENT_EXCEPTIONS:
        cond = f"{intent} = {lit(name)} AND {contains_any(low, words)}"
        act.append(f"WHEN {cond} THEN {lit(fixed.ESCALATE)}")
        why.append(f"WHEN {cond} THEN {lit(er)}")
        act.append(f"WHEN {intent} = {lit(name)} THEN {lit(fixed.AUTO_HANDLE)}")
        why.append(f"WHEN {intent} = {lit(name)} THEN {lit(ar)}")
    return ("CASE " + " ".join(act) + f" ELSE {lit(fixed.AUTO_HANDLE)} END",
            "CASE " + " ".join(why) + f" ELSE {lit(fixed.GT_DEFAULT_REASON)} END")


def fmt2(x: str) -> str:
    return f"printf('%.2f', CAST({x} AS DOUBLE))"


def first_word_match(low: str, words) -> str:
    parts = " ".join(
        f"WHEN regexp_matches({low}, {lit(chr(92) + 'b' + regex_escape(w) + chr(92) + 'b')}) THEN {lit(w)}"
        for w in words)
    return f"(CASE {parts} END)"


def template(tpl: str, **values: str) -> str:
    """SQL concat of a ``{name}`` template."""
    import re
    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", tpl):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(values[piece[1:-1]])
        else:
            parts.append(lit(piece))
    return "(" + " || ".join(parts) + ")"


def escalation(message: str, intent: str, conf: str, max_sim: str, threat_keywords, sensitive_intents,
               thr: float, min_sim: float) -> tuple[str, str]:
    low = f"lower({nn(message)})"
    kw = first_word_match(low, threat_keywords)
    esc, auto = lit(fixed.ESCALATE), lit(fixed.AUTO_HANDLE)
    conds = [
        (f"{kw} IS NOT NULL", esc, template(fixed.REASON_THREAT, kw=kw)),
        (f"{intent} = {lit(fixed.DELIVERY_INTENT)} AND {contains_any(low, fixed.DELIVERY_THREAT_PHRASES)}", esc,
         lit(fixed.REASON_DELIVERY)),
        (f"{intent} IN ({', '.join(lit(i) for i in sensitive_intents)})", esc,
         template(fixed.REASON_SENSITIVE, intent=intent)),
        (f"{conf} < {thr}", esc, template(fixed.REASON_LOW_CONFIDENCE, conf=fmt2(conf), thr=lit(f"{thr:.2f}"))),
        (f"{max_sim} < {min_sim}", esc,
         template(fixed.REASON_WEAK_EVIDENCE, sim=fmt2(max_sim), min_sim=lit(f"{min_sim:.2f}"))),
    ]
    action = "CASE " + " ".join(f"WHEN {c} THEN {a}" for c, a, _ in conds) + f" ELSE {auto} END"
    reason = ("CASE " + " ".join(f"WHEN {c} THEN {r}" for c, _, r in conds)
              + f" ELSE {template(fixed.REASON_AUTO, conf=fmt2(conf), sim=fmt2(max_sim))} END")
    return action, reason


def keyword_vector(x: str) -> str:
    """L2-normalised keyword-count vector (the SQL twin of ``keyword_encoder``)."""
    low = f"lower({nn(x)})"
    counts = "[" + ", ".join(f"CAST({keyword_count(low, kw)} AS DOUBLE)" for kw in keyword_vocabulary()) + "]"
    return counts
