"""The same results in DuckDB's SQL, written another way.

Code is cut into tokens here and calls, brackets and functions are found with
window functions over a token table, while the Spark side folds inside a row.
"""

from __future__ import annotations

from vettica.functions.secret_rules import SECRET_RULES
from vettica.functions.sink_rules import (
    ALLOCATION,
    ALLOCATION_CWE,
    ANY_COMMAND,
    BUFFER,
    BUFFER_CWE,
    COMMAND,
    COMMAND_CWE,
    DELETE_CWE,
    FORMAT,
    FORMAT_CWE,
    MEMORY,
    MEMORY_CWE,
)
from vettica.operators.findings import (
    LOW_CONFIDENCE_CWES,
    LOW_CONFIDENCE_NOTE,
    UNSUPPORTED_NOTE,
)
from vettica.plans import derived as D


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*ctes: tuple[str, str], final: str) -> str:
    parts = ",\n".join(f"{name} as ({body})" for name, body in ctes)
    return f"with {parts}\n{final}"


# --- corpora -------------------------------------------------------------

CORPUS = ("code_corpus", D.CODE_CORPUS)
TEXTS = ("texts", D.TEXT_CORPUS)
PRUNED = (
    "not regexp_matches(path, '(^|/)(\\.[^/]*|node_modules|__pycache__|venv)/')"
)
NOT_BINARY = "position(chr(0) in substr(text, 1, 8192)) = 0"
SUFFIX = "regexp_extract(path, '^(?:.*/)?[^/]+?(\\.[^./]+)$', 1)"


def rule_lang(suffix: str = SUFFIX) -> str:
    return (
        f"case {suffix} when '.py' then 'python' when '.java' then 'java' when '.c' then 'c'"
        " when '.h' then 'c' when '.cpp' then 'cpp' when '.cc' then 'cpp' when '.cxx' then 'cpp'"
        " when '.hpp' then 'cpp' when '.hh' then 'cpp' end"
    )


def display(lang: str) -> str:
    return (
        f"case {lang} when 'python' then 'Python' when 'java' then 'Java' when 'c' then 'C'"
        " when 'cpp' then 'C++' end"
    )


# --- lines and secrets ---------------------------------------------------

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def lines(source: str) -> tuple[str, str]:
    return (
        "lines",
        f"""
select path, cast(line as int) as line, text from (
  select path, unnest(parts) as text, generate_subscripts(parts, 1) as line, len(parts) as n
  from (select path, string_split_regex(text, {quoted(LINE_END)}) as parts from {source}))
where line < n or text <> ''""",
    )


def secret_hits(source: str, rules: tuple[int, ...] = (1, 2, 3, 4, 5)) -> list[tuple[str, str]]:
    scans = " union all ".join(
        f"select path, line, '{rule.rule_id}' as rule_id, {order} as rule_order,"
        f" regexp_extract(text, {quoted(rule.pattern.replace('(?iU)', '(?i)'))}, 0) as found"
        " from lines"
        for order, rule in enumerate(SECRET_RULES, start=1)
        if order in rules
    )
    return [lines(source), ("hits", f"select * from ({scans}) where found <> ''")]


def redact(value: str, visible: int = 4) -> str:
    return (
        f"case when length({value}) <= {visible} then repeat('*', length({value}))"
        f" else concat(substr({value}, 1, {visible}), '****(',"
        f" cast(length({value}) - {visible} as varchar), ' more chars)') end"
    )


SECRET_FINDING_COLUMNS = f"""
1 as layer, path, line as start_line, 1 as start_column, rule_order,
concat('secret/', rule_id) as rule_id,
concat('Hardcoded secret detected (rule: ', rule_id, '): ', {redact('found')}) as message,
'error' as severity, cast(1 as double) as confidence"""


def secret_query(*rules: int) -> str:
    return _with(
        TEXTS,
        *secret_hits("texts", rules),
        final=f"select path, line, rule_id, {redact('found')} as redacted_text,"
        " cast(length(found) as int) as matched_length from hits",
    )


# --- tokens --------------------------------------------------------------

_STRING = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
_CHAR = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
_REST = r"[A-Za-z_$][\w$]*|::|->|[^\S\n]+|\n|[\s\S]"
BRACE_TOKENS = rf"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|{_STRING}|{_CHAR}|{_REST}"
PYTHON_TOKENS = rf"#[^\n]*|{_STRING}|{_CHAR}|{_REST}"

PLACED = "partition by path order by i rows between unbounded preceding and 1 preceding"


def tokens(source: str = "code_corpus") -> list[tuple[str, str]]:
    return [
        (
            "cut",
            f"""
select path, lang, text, generate_subscripts(parts, 1) as i, unnest(parts) as tok from (
  select path, lang, text, case when lang = 'python'
           then regexp_extract_all(text, {quoted(PYTHON_TOKENS)})
           else regexp_extract_all(text, {quoted(BRACE_TOKENS)}) end as parts
  from (select path, text, {rule_lang()} as lang from {source}) where lang is not null)""",
        ),
        (
            "sized",
            """
select path, lang, i, tok, strlen(tok) as size,
       length(tok) - length(replace(tok, chr(10), '')) as breaks,
       case when lang = 'python' and tok[1] = '#' then 'comment'
            when lang <> 'python' and tok[1:2] in ('//', '/*') then 'comment'
            when tok[1] in ('"', chr(39)) and length(tok) > 1 then 'string'
            when regexp_full_match(tok, '\\s+') then 'space'
            when regexp_matches(tok, '^[A-Za-z_$]') then 'name'
            else 'symbol' end as kind
from cut""",
        ),
        (
            "offsets",
            f"""
select *, coalesce(sum(size) over ({PLACED}), 0) as off,
       1 + coalesce(sum(breaks) over ({PLACED}), 0) as line
from sized""",
        ),
        (
            "toks",
            f"""
select *, off - coalesce(max(case when breaks > 0
              then off + size - strlen(string_split(tok, chr(10))[-1]) end) over ({PLACED}), 0) + 1
          as col
from offsets""",
        ),
    ]


_LAGS = ", ".join(f"lag(tok, {k}, '') over w as p{k}" for k in range(1, 8))

NOT_CALLED = (
    "'if','for','while','switch','catch','return','sizeof','def','class','and','or','not','in'"
)
WORDS_BEFORE = "'return','else','case','throw','do','yield','assert','and','or','not','in','is','if'"


def call_ctes(source: str = "code_corpus") -> list[tuple[str, str]]:
    return [
        *tokens(source),
        (
            "kept",
            """
select *, row_number() over (partition by path order by i) as r
from toks where kind not in ('space', 'comment')""",
        ),
        (
            "sig",
            f"""
select *, {_LAGS}, lead(tok, 1, '') over w as n1, lead(tok, 2, '') over w as n2,
       lead(tok, 3, '') over w as n3, lag(kind, 1, '') over w as k1, lag(kind, 2, '') over w as k2,
       lag(kind, 3, '') over w as k3,
       sum(case tok when '(' then 1 when ')' then -1 else 0 end) over w
         + case when tok = ')' then 1 else 0 end as plevel,
       sum(case tok when '{{' then 1 when '}}' then -1 else 0 end) over w
         + case when tok = '}}' then 1 else 0 end as blevel
from kept window w as (partition by path order by r)""",
        ),
        (
            "parens",
            """
select path, r, opened from (
  select path, r, tok, max(case when tok = '(' then r end)
           over (partition by path, plevel order by r) as opened
  from sig where tok in ('(', ')')) where tok = ')'""",
        ),
        (
            "heads",
            """
select parens.path as path, parens.r as r, sig.p1 as head, sig.p2 as before_head, sig.k1 as head_kind
from parens join sig on sig.path = parens.path and sig.r = parens.opened""",
        ),
        (
            "calls",
            f"""
select * from (
  select *, case
      when lang = 'cpp' and tok = 'delete' and p1 not in ('=', 'operator') then 'keyword'
      when kind <> 'name' or n1 <> '(' or tok in ({NOT_CALLED}) then null
      when p1 in ('.', '->') then 'member'
      when p1 = 'new' then 'new'
      when lang = 'python' and p1 in ('def', 'class') then null
      when p1 = '::' then case when k3 = 'name' and p3 not in ({WORDS_BEFORE}) then null
                               else 'scoped' end
      when lang <> 'python' and k1 = 'name' and p1 not in ({WORDS_BEFORE}) then null
      else 'call' end as form
  from sig) where form is not null""",
        ),
    ]


# --- functions -----------------------------------------------------------

FUNCTIONS = [
    (
        "brace_pairs",
        """
select * from (
  select path, lang, r, tok, p1, p2, p3, blevel, off,
         first_value(off) over following as close_off,
         first_value(line) over following as close_line,
         first_value(col) over following as close_col,
         coalesce(max(case when tok in ('{', '}') then r end)
           over (partition by path order by r rows between unbounded preceding and 1 preceding), 0)
           as last_brace
  from sig where tok in ('{', '}') and lang <> 'python'
  window following as (partition by path, blevel order by r
                       rows between 1 following and unbounded following))
where tok = '{'""",
    ),
    (
        "stops",
        """
select path, r, max(case when tok in ('{', '}', ';')
                           or (tok = ':' and p1 in ('public', 'private', 'protected')) then r end)
         over (partition by path order by r rows between unbounded preceding and 1 preceding)
         as stop
from sig where lang <> 'python'""",
    ),
    (
        "brace_functions",
        """
select b.path, b.lang, s.off as start_off, s.line as start_line, s.col as start_col,
       b.close_off + 1 as end_off, b.close_line as end_line, b.close_col as end_col
from brace_pairs b
join heads h on h.path = b.path
     and h.r = case when b.p1 = ')' then b.r - 1 when b.p2 = 'throws' and b.p3 = ')' then b.r - 3 end
join stops t on t.path = b.path and t.r = b.r
join sig s on s.path = b.path and s.r = coalesce(t.stop, 0) + 1
where h.head_kind = 'name' and h.head not in ('if', 'for', 'while', 'switch', 'catch')""",
    ),
    (
        "code_lines",
        """
select path, line, min(col) as col, min(off) as off, max(off + size) as end_off,
       max(col + size - 1) as end_col, arg_min(tok, off) as first
from sig where lang = 'python' group by path, line""",
    ),
    (
        "def_ends",
        """
select d.path, d.line, d.col, d.off, min(n.line) as next_line
from code_lines d left join code_lines n on n.path = d.path and n.line > d.line and n.col <= d.col
where d.first = 'def' group by d.path, d.line, d.col, d.off""",
    ),
    (
        "python_functions",
        """
select d.path, 'python' as lang, d.off as start_off, d.line as start_line, d.col as start_col,
       max(b.end_off) as end_off, max(b.line) as end_line, arg_max(b.end_col, b.line) as end_col
from def_ends d join code_lines b
  on b.path = d.path and b.line >= d.line and (d.next_line is null or b.line < d.next_line)
group by d.path, d.off, d.line, d.col""",
    ),
    (
        "functions",
        "select * from brace_functions union all select * from python_functions",
    ),
]


# --- sinks ---------------------------------------------------------------


def component(words: str) -> str:
    """RE2 has no look-ahead: the first letter is spelled as a capital."""
    humps = "|".join(f"{w[0].upper()}(?i:{w[1:]})" for w in words.split("|"))
    return f"(^|_)({words})($|_)|(^|[a-z0-9_])({humps})($|[A-Z]|[^a-zA-Z0-9])"


def _named(words: str) -> str:
    return f"regexp_matches(tok, {quoted(component(words))})"


_ONE_SCOPE = "(k2 = 'name' and p3 <> '::')"
_ONE_RECEIVER = "(k2 = 'name' and p3 not in ('.', '->'))"
_C_GROUPS = (
    (BUFFER, BUFFER_CWE),
    (MEMORY, MEMORY_CWE),
    (FORMAT, FORMAT_CWE),
    (ANY_COMMAND, COMMAND_CWE),
    (ALLOCATION, ALLOCATION_CWE),
)


def _conditions() -> list[tuple[str, int, str, tuple[str, ...]]]:
    rules = [
        ("c", no, f"form = 'call' and {_named(words)}", cwe)
        for no, (words, cwe) in enumerate(_C_GROUPS, start=1)
    ]

    def cpp(no: int, form: str, words: str, cwe: tuple[str, ...]) -> None:
        scope = f" and {_ONE_SCOPE}" if form == "scoped" else ""
        rules.append(("cpp", no, f"form = '{form}' and {_named(words)}{scope}", cwe))

    cpp(1, "call", BUFFER, BUFFER_CWE)
    cpp(2, "scoped", BUFFER, BUFFER_CWE)
    cpp(3, "call", MEMORY, MEMORY_CWE)
    cpp(4, "scoped", MEMORY, MEMORY_CWE)
    rules.append(("cpp", 5, "form = 'keyword'", DELETE_CWE))
    cpp(6, "call", FORMAT, FORMAT_CWE)
    cpp(7, "scoped", FORMAT, FORMAT_CWE)
    cpp(8, "call", ANY_COMMAND, COMMAND_CWE)
    cpp(9, "scoped", COMMAND, COMMAND_CWE)
    cpp(10, "call", ALLOCATION, ALLOCATION_CWE)
    member = "form = 'member' and "
    rules += [
        ("java", 1, member + "tok = 'exec' and p2 = ')' and p3 = '(' and p4 = 'getRuntime'"
         " and p5 = '.' and p6 = 'Runtime' and p7 <> '.'", ()),
        ("java", 2, member + "tok = 'start' and p2 = ')' and head = 'ProcessBuilder'"
         " and before_head = 'new'", ()),
        ("java", 3, "form in ('member', 'call')"
         " and tok in ('execute', 'executeQuery', 'executeUpdate')", ()),
        ("java", 4, member + f"tok = 'readObject' and {_ONE_RECEIVER}", ()),
        ("java", 5, "form = 'new' and tok = 'XMLDecoder'", ()),
        ("java", 6, member + "tok = 'getInstance' and p2 = 'MessageDigest' and p3 <> '.'"
         """ and n2 in ('"MD5"', '"SHA1"', '"SHA-1"') and n3 in (')', ',')""", ()),
        ("python", 1, member + "tok in ('system', 'popen') and p2 = 'os' and p3 <> '.'", ()),
        ("python", 2, member + "tok in ('call', 'run', 'Popen', 'check_output', 'check_call')"
         " and p2 = 'subprocess' and p3 <> '.'", ()),
        ("python", 3, "form = 'call' and tok in ('eval', 'exec')", ()),
        ("python", 4, member + "tok in ('loads', 'load') and p2 = 'pickle' and p3 <> '.'", ()),
        ("python", 5, member + "tok = 'load' and p2 = 'yaml' and p3 <> '.'", ()),
        ("python", 6, member + f"tok = 'execute' and {_ONE_RECEIVER}", ()),
    ]
    return rules


def candidate_ctes(source: str = "code_corpus", *langs: str) -> list[tuple[str, str]]:
    matched = " union all ".join(
        f"select path, lang, line, col, off, tok, {no} as rule_no, {quoted(','.join(cwe))} as cwe"
        f" from headed where lang = '{lang}' and {test}"
        for lang, no, test, cwe in _conditions()
        if not langs or lang in langs
    )
    return [
        *call_ctes(source),
        *FUNCTIONS,
        (
            "headed",
            """
select calls.*, heads.head as head, heads.before_head as before_head
from calls left join heads on heads.path = calls.path and heads.r = calls.r - 2""",
        ),
        ("matched", matched),
        (
            "placed",
            """
select * from (
  select m.*, f.start_off, f.end_off, f.start_line, f.end_line,
         row_number() over (partition by m.path, m.off, m.rule_no
                            order by f.start_off desc) as nearest
  from matched m left join functions f
    on f.path = m.path and f.start_off <= m.off and m.off < f.end_off)
where nearest = 1""",
        ),
        (
            "candidates",
            f"""
select p.path as path, p.lang as lang, cast(p.line as int) as line, cast(p.col as int) as "column",
       p.tok as sink_name, p.rule_no as rule_no, p.cwe as cwe,
       cast(p.start_line as int) as function_line, cast(p.end_line as int) as function_end_line,
       case when p.start_off is null
            then regexp_replace(string_split(c.text, chr(10))[cast(p.line as int)],
                                '^\\s+|\\s+$', '', 'g')
            else substr(c.text, cast(p.start_off as int) + 1,
                        cast(p.end_off - p.start_off as int)) end as snippet
from placed p join {source} c on c.path = p.path""",
        ),
    ]


# --- verdicts and findings -----------------------------------------------

NORMALIZED = (
    "case lower(trim(spelled)) when 'c++' then 'cpp' when 'cxx' then 'cpp' when 'cc' then 'cpp'"
    " else lower(trim(spelled)) end"
)
SCORED = [
    ("scored", D.SCORED_CANDIDATES),
    ("routed", f"select *, {NORMALIZED} as lang, cwe_list as cwe from scored"),
]


def verdicts(source: str) -> tuple[str, str]:
    threshold, low, high = (D.POLICY_SQL[k] for k in ("threshold", "low", "high"))
    return (
        "verified",
        f"""
select *, lang in ('c', 'cpp', 'java') as ml_verified,
       case when lang in ('c', 'cpp', 'java') then score end as confidence,
       cast(case when lang not in ('c', 'cpp', 'java') then null
                 when score >= {threshold} then 1 else 0 end as int) as label,
       case when lang not in ('c', 'cpp', 'java') then 'ML_NOT_SUPPORTED'
            when score between {low} and {high} then 'UNCERTAIN_NEEDS_REVIEW'
            else 'OK' end as status
from {source}""",
    )


_LOW_CODES = "|".join(code.split("-")[1] for code in LOW_CONFIDENCE_CWES)
LOW = (
    f"(ml_verified and sink_name <> 'delete' and regexp_matches(cwe, 'CWE-({_LOW_CODES})\\b'))"
)
DECIDED = (
    "decided",
    """
select * from (
  select *, case when not ml_verified then 'warning'
                 when status = 'UNCERTAIN_NEEDS_REVIEW' then 'warning'
                 when label = 1 then 'error' end as severity from verified)
where severity is not null""",
)
OVERRIDDEN = (
    "overridden",
    f"""
select * exclude (severity), case when {LOW} then 'warning' else severity end as severity,
       case when {LOW} then true end as low_confidence_category,
       case when {LOW} then {quoted(LOW_CONFIDENCE_NOTE)}
            when not ml_verified then {quoted(UNSUPPORTED_NOTE)} end as note
from decided""",
)
_TAGS = (
    "case when cwe = '' then '' else concat(' [', replace(replace(cwe, ', ', ','), ',', ', '), ']')"
    " end"
)
MESSAGE = f"""
concat('Candidate sink ''', sink_name, '''', {_TAGS},
  case when not ml_verified then ' detected by Layer 2, NOT YET verified by Layer 3 (ML) because'
              || ' this language is outside the model''s supported scope.'
       when status = 'UNCERTAIN_NEEDS_REVIEW' then
         concat(' — the model isn''t confident enough to conclude (confidence=',
                format('{{:.3f}}', confidence), ' falls within the uncertain zone), needs manual review.')
       else concat(' — the model confirms it is VULNERABLE (confidence=',
                   format('{{:.3f}}', confidence), ').') end)"""
SINK_FINDING_COLUMNS = f"""
2 as layer, path, line as start_line, "column" as start_column, rule_no as rule_order,
concat('sink/', sink_name) as rule_id, {MESSAGE} as message, severity,
coalesce(confidence, cast(0 as double)) as confidence"""
#: What follows the confidence among the properties of a sink finding.
SINK_PROPERTIES = """
concat(case when cwe <> '' then
         concat(',"cwe":', cast(to_json(string_split(replace(cwe, ', ', ','), ',')) as varchar)) end,
       ',"ml_verified":', cast(ml_verified as varchar),
       case when ml_verified then concat(',"status":"', status, '"') end,
       case when label is not null then concat(',"label":', cast(label as varchar)) end,
       case when low_confidence_category then ',"low_confidence_category":true' end,
       case when note is not null then concat(',"note":', cast(to_json(note) as varchar)) end)"""
FINDINGS = [
    DECIDED,
    OVERRIDDEN,
    (
        "findings",
        f"select {SECRET_FINDING_COLUMNS}, '' as properties from hits"
        f" union all select {SINK_FINDING_COLUMNS}, {SINK_PROPERTIES} as properties from overridden",
    ),
]
RESULT = """
concat('{"ruleId":', cast(to_json(rule_id) as varchar), ',"level":"', severity,
       '","message":{"text":', cast(to_json(message) as varchar),
       '},"locations":[{"physicalLocation":{"artifactLocation":{"uri":',
       cast(to_json(path) as varchar), '},"region":{"startLine":', cast(start_line as varchar),
       ',"startColumn":', cast(start_column as varchar), '}}}],"properties":{"confidence":',
       cast(confidence as varchar), properties, '}}')"""
RULE = """concat('{"id":', cast(to_json(rule_id) as varchar), ',"shortDescription":{"text":',
       cast(to_json(rule_id) as varchar), '}}')"""
POSITION = "layer, path, start_line, start_column, rule_order"


def report_lines(run: str) -> str:
    """The lines of a document for each value of ``run`` over the findings."""
    head = (
        '{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/'
        'sarif-schema-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"vettica","rules":['
    )
    return f"""
select run_id, section, line from
  (select distinct {run} as run_id from findings),
  (values (0, '{head}'), (2, ']}}}},"results":['), (4, ']}}]}}')) frame(section, line)
union all
select run_id, 1, concat(case when n > 1 then ',' else '' end, {RULE}) from (
  select run_id, rule_id, row_number() over (partition by run_id order by {POSITION}) as n from (
    select {run} as run_id, *, row_number() over (partition by {run}, rule_id order by {POSITION}) as k
    from findings) where k = 1)
union all
select run_id, 3, concat(case when n > 1 then ',' else '' end, {RESULT}) from (
  select {run} as run_id, *, row_number() over (partition by {run} order by {POSITION}) as n from findings)"""


FINDING_OUTPUT = (
    "select layer, path, start_line, start_column, rule_order, rule_id, message, severity,"
    " confidence from findings"
)
SCORE = (
    "cast((length(snippet) * 37 + line * 11 + \"column\") % 1001 as double) / cast(1000 as double)"
)
CASCADE = [
    ("scored", f"select *, {SCORE} as score from candidates"),
    verdicts("scored"),
]
_UNSEEN = "case when not ml_verified then 1 else 0 end"


def warning() -> str:
    lang = f"coalesce({display(rule_lang())}, case when regexp_replace({SUFFIX}, '^\\.+', '') = ''" \
        f" then 'unknown' else regexp_replace({SUFFIX}, '^\\.+', '') end)"
    return f"""
case when sum({_UNSEEN}) > 0 then concat('⚠️  ', cast(sum({_UNSEEN}) as varchar),
  ' candidate(s) from language(s) ',
  array_to_string(list_sort(list(distinct {lang}) filter (where not ml_verified)), ', '),
  ' not yet AI-verified (Layer 1+2 only) — confidence is much lower than C/C++/Java,'
  || ' needs closer manual review.') end"""


# --- evaluation ----------------------------------------------------------

_EVAL_LANG = f"case when {rule_lang(SUFFIX.replace('path', 'file_name'))} in ('c', 'cpp')" \
    f" then {rule_lang(SUFFIX.replace('path', 'file_name'))} end"
_BLANK = "regexp_full_match({0}, '\\s*')"
PAIRS = [
    ("pairs", D.PAIRS),
    (
        "judged",
        f"""
select *, {_EVAL_LANG} as lang, ({_BLANK.format('func_src_before')}
       or {_BLANK.format('func_src_after')} or func_src_before = func_src_after) as degenerate
from pairs""",
    ),
]
PREDICTIONS = [
    ("labelled", D.LABELLED),
    ("scored", "select lang, label as y, score from labelled where lang in ('c', 'cpp', 'java')"),
    verdicts("scored"),
    ("predictions", "select lang, y, label as pred, status from verified"),
]
CONFUSION = """
count(*) as n,
count(case when y = 1 and pred = 1 then 1 end) as tp,
count(case when y = 0 and pred = 1 then 1 end) as fp,
count(case when y = 0 and pred = 0 then 1 end) as tn,
count(case when y = 1 and pred = 0 then 1 end) as fn"""


def _ratio(top: str, bottom: str) -> str:
    return f"case when {bottom} > 0 then cast({top} as double) / ({bottom}) else 0 end"


METRICS = [
    (
        "ratios",
        f"""
select *, round({_ratio('tp + tn', 'n')}, 9) as accuracy,
       {_ratio('tp', 'tp + fp')} as p, {_ratio('tp', 'tp + fn')} as q
from confusion""",
    ),
]
METRIC_COLUMNS = (
    "accuracy, round(p, 9) as precision, round(q, 9) as recall,"
    " round(case when p + q > 0 then 2 * p * q / (p + q) else 0 end, 9) as f1"
)


def oracle_sql() -> dict[str, str]:
    text_lines = _with(TEXTS, lines("texts"), final="select path, line, text from lines")
    cand = 'path, lang, line, "column", sink_name, rule_no, cwe'

    def sinks(lang: str) -> str:
        return _with(CORPUS, *candidate_ctes("code_corpus", lang), final=f"select {cand} from candidates")

    def on_findings(final: str) -> str:
        return _with(TEXTS, *secret_hits("texts"), *SCORED, verdicts("routed"), *FINDINGS, final=final)

    def on_cascade(final: str, source: str = "scannable", extra: tuple = ()) -> str:
        return _with(
            CORPUS,
            *extra,
            ("scannable", f"select path, text from code_corpus where {PRUNED}"
                          f" and length <= 5242880 and {NOT_BINARY}"),
            *secret_hits(source),
            *candidate_ctes(source),
            *CASCADE,
            *FINDINGS,
            final=final,
        )

    snapshots = (("old_files", D.OLD_SNAPSHOT), ("new_files", D.NEW_SNAPSHOT))
    change = """
select n.path as path, case when o.hash is null then 'added' else 'modified' end as change
from new_files n left join old_files o on o.path = n.path
where o.hash is null or o.hash <> n.hash"""
    probability = "exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1)))"
    names = "select name from names"
    groups = ", ".join(
        f"regexp_matches(name, {quoted(component(words))}) as {label}"
        for label, words in (
            ("buffer", BUFFER), ("memory", MEMORY), ("format", FORMAT),
            ("command", ANY_COMMAND), ("allocation", ALLOCATION),
        )
    )
    return {
        # sources
        "corpus_load": _with(
            CORPUS,
            final=f"select path, length, md5(text) as hash from code_corpus where {PRUNED}"
            f" and length <= 5242880 and {NOT_BINARY}",
        ),
        "prune_dirs": _with(CORPUS, final=f"select path from code_corpus where {PRUNED}"),
        "filter_size": _with(
            CORPUS, final="select path, length from code_corpus where length <= 5242880"
        ),
        "filter_binary": _with(CORPUS, final=f"select path from code_corpus where {NOT_BINARY}"),
        "decode_text": "select cast(doc_id as varchar) as path, concat(text, text, '(') as text"
        " from documents",
        "skip_report": _with(
            CORPUS,
            final=f"""
select * from (select case when length > 5242880 then 'too large'
                           when not ({NOT_BINARY}) then 'suspected binary' end as reason,
                      count(*) as files, cast(sum(length) as bigint) as bytes
               from code_corpus where {PRUNED} group by 1) where reason is not null""",
        ),
        "changed_files": _with(CORPUS, *snapshots, final=change),
        "split_lines": text_lines,
        # lookups
        "language_of_path": _with(
            CORPUS,
            final=f"select path, {rule_lang()} as lang, case when {rule_lang()} = 'python' then ''"
            f" else coalesce({rule_lang()}, '') end as model_lang from code_corpus",
        ),
        "normalize_language": _with(
            SCORED[0], final=f"select candidate_id, {NORMALIZED} as lang from scored"
        ),
        "display_language": _with(
            CORPUS,
            final=f"select path, coalesce({display(rule_lang())}, case when {SUFFIX} = ''"
            f" then 'unknown' else regexp_replace({SUFFIX}, '^\\.+', '') end) as language"
            " from code_corpus",
        ),
        # secrets
        "secrets_aws": secret_query(1),
        "secrets_api_key": secret_query(2),
        "secrets_private_key": secret_query(3),
        "secrets_slack": secret_query(4),
        "secrets_assignment": secret_query(5),
        "secret_scan": secret_query(1, 2, 3, 4, 5),
        "redact_secret": f"select p_partkey, {redact('p_name')} as four,"
        f" {redact('p_name', 2)} as two, {redact('p_brand', 12)} as twelve from part",
        "secret_findings": _with(
            TEXTS, *secret_hits("texts"), final=f"select {SECRET_FINDING_COLUMNS} from hits"
        ),
        # code
        "code_tokens": _with(
            CORPUS,
            *tokens(),
            final='select path, lang, cast(i as int) as token_no, tok as token, kind,'
            ' cast(line as int) as line, cast(col as int) as "column" from toks',
        ),
        "call_sites": _with(
            CORPUS,
            *call_ctes(),
            final='select path, lang, cast(line as int) as line, cast(col as int) as "column",'
            " tok as name, form from calls",
        ),
        "match_sink_name": _with(
            ("names", D.NAMES), final=f"select name, {groups} from ({names})"
        ),
        "sinks_c": sinks("c"),
        "sinks_cpp": sinks("cpp"),
        "sinks_java": sinks("java"),
        "sinks_python": sinks("python"),
        "cwe_tags": _with(
            CORPUS,
            *candidate_ctes(),
            final="select lang, code as cwe, count(*) as candidates from ("
            "select lang, unnest(string_split(cwe, ',')) as code from candidates)"
            " where code <> '' group by lang, code",
        ),
        "function_spans": _with(
            CORPUS,
            *call_ctes(),
            *FUNCTIONS,
            final="select path, lang, cast(start_line as int) as start_line,"
            " cast(start_col as int) as start_column, cast(end_line as int) as end_line,"
            " cast(end_col as int) as end_column from functions",
        ),
        "enclosing_function": _with(
            CORPUS,
            *candidate_ctes(),
            final='select path, line, "column", sink_name, rule_no, function_line,'
            " function_end_line, snippet from candidates",
        ),
        "sink_candidates": _with(
            CORPUS, *candidate_ctes(), final=f"select {cand}, snippet from candidates"
        ),
        "candidates_by_rule": _with(
            CORPUS,
            *candidate_ctes(),
            final="select lang, sink_name, cwe, count(*) as candidates from candidates"
            " group by lang, sink_name, cwe",
        ),
        # verification
        "route_ml": _with(
            *SCORED,
            final="select candidate_id, lang, lang in ('c', 'cpp', 'java') as supported,"
            " case when lang in ('c', 'cpp', 'java') then 'SCORE' else 'ML_NOT_SUPPORTED' end"
            " as route from routed",
        ),
        "score_batches": _with(
            CORPUS,
            *candidate_ctes(),
            final="select concat(path, ':', cast(line as varchar), ':', cast(\"column\" as varchar),"
            " ':', cast(rule_no as varchar)) as candidate_id,"
            " cast(length(snippet) % 997 as double) / 997 as score"
            " from candidates where lang <> 'python'",
        ),
        "softmax_prob": f"""
select vec_id, round({probability}, 9) as probability from (
  select vec_id, cast(embedding[1] as double) as l0, cast(embedding[2] as double) as l1
  from embeddings)""",
        "classify": _with(
            *SCORED,
            verdicts("routed"),
            final="select candidate_id, lang, ml_verified, confidence, label, status from verified",
        ),
        "verify_candidates": _with(
            *SCORED,
            verdicts("routed"),
            final="select candidate_id, ml_verified, confidence, label, status from verified",
        ),
        # triage
        "decide_findings": _with(
            *SCORED,
            verdicts("routed"),
            DECIDED,
            final="select candidate_id, severity, status, label from decided",
        ),
        "low_confidence_override": _with(
            *SCORED,
            verdicts("routed"),
            DECIDED,
            OVERRIDDEN,
            final="select candidate_id, severity, low_confidence_category, note, confidence"
            " from overridden",
        ),
        "finding_messages": _with(
            *SCORED,
            verdicts("routed"),
            DECIDED,
            final=f"select candidate_id, {MESSAGE} as message from decided",
        ),
        "all_findings": on_findings(FINDING_OUTPUT),
        "sarif_rules": on_findings(
            "select rule_id, first.layer as layer, first.path as path,"
            " first.start_line as start_line, first.start_column as start_column,"
            " first.rule_order as rule_order from (select rule_id, min({'layer': layer,"
            " 'path': path, 'start_line': start_line, 'start_column': start_column,"
            " 'rule_order': rule_order}) as first from findings group by rule_id)"
        ),
        "sarif_results": on_findings(f"select {POSITION}, {RESULT} as result from findings"),
        "sarif_report": on_findings(report_lines("string_split(path, '/')[1]")),
        "sarif_write": on_findings(f"select line from ({report_lines('1')})"),
        "unsupported_warning": _with(
            *SCORED, verdicts("routed"), final=f"select {warning()} as warning from verified"
        ),
        "scan_summary": _with(
            TEXTS,
            *secret_hits("texts"),
            *SCORED,
            verdicts("routed"),
            *FINDINGS,
            final=f"""
select (select count(*) from verified) as candidate_count,
       (select count(*) from findings) as finding_count,
       (select count(*) from hits) as secret_count,
       (select {warning()} from verified) as warning""",
        ),
        "cascade": on_cascade(FINDING_OUTPUT),
        "streaming_scan": on_cascade(FINDING_OUTPUT),
        "incremental_scan": on_cascade(
            FINDING_OUTPUT,
            "touched",
            (
                *snapshots,
                ("changed", change),
                ("touched", f"select path, text from code_corpus where"
                            f" length <= 5242880 and {NOT_BINARY}"
                            " and path in (select path from changed)"),
            ),
        ),
        # evaluation
        "eval_examples": _with(
            *PAIRS,
            final="""
select func_name, lang, vul_type, code, label from (
  select func_name, lang, vul_type, func_src_before as code, 1 as label from judged
    where lang is not null and not degenerate
  union all
  select func_name, lang, vul_type, func_src_after as code, 0 as label from judged
    where lang is not null and not degenerate)""",
        ),
        "eval_stats": _with(
            *PAIRS,
            final="""
select count(*) as total_rows, count(case when lang is null then 1 end) as skipped_language,
       count(case when lang is not null and degenerate then 1 end) as skipped_degenerate,
       count(case when lang is not null and not degenerate then 1 end) * 2 as examples
from judged""",
        ),
        "balance_per_language": _with(
            ("labelled", D.LABELLED),
            *_BALANCED,
            final="select doc_id, lang, label from balanced",
        ),
        "confusion_matrix": _with(
            *PREDICTIONS, final=f"select lang, {CONFUSION} from predictions group by lang"
        ),
        "classifier_metrics": _with(
            *PREDICTIONS,
            ("confusion", f"select lang, {CONFUSION} from predictions group by lang"),
            *METRICS,
            final=f"select lang, n, {METRIC_COLUMNS} from ratios",
        ),
        "metrics_rollup": _with(
            *PREDICTIONS,
            (
                "confusion",
                "select case when grouping(lang) = 1 then 'combined' else lang end as lang,"
                f" {CONFUSION}, count(case when status = 'UNCERTAIN_NEEDS_REVIEW' then 1 end)"
                " as uncertain from predictions group by rollup(lang)",
            ),
            *METRICS,
            final=f"select lang, n, tp, fp, tn, fn, uncertain, {METRIC_COLUMNS} from ratios",
        ),
        "uncertain_counts": _with(
            *PREDICTIONS,
            final="select case when grouping(lang) = 1 then 'combined' else lang end as lang,"
            " count(*) as n, count(case when status = 'UNCERTAIN_NEEDS_REVIEW' then 1 end)"
            " as uncertain from predictions group by rollup(lang)",
        ),
        "class_counts": _with(
            ("labelled", D.LABELLED),
            *_BALANCED,
            final="""
select lang, count(case when label = 1 then 1 end) as positive,
       count(case when label = 0 then 1 end) as negative, count(*) as total
from balanced group by lang""",
        ),
    }


_BALANCED = [
    (
        "ranked",
        """
select *, row_number() over (partition by lang, label
                             order by md5(cast(doc_id as varchar))) as nth from labelled""",
    ),
    (
        "targets",
        """
select lang, min(n) as target from (
  select lang, label, count(*) as n from labelled group by lang, label)
group by lang having count(*) > 1""",
    ),
    (
        "balanced",
        "select ranked.* from ranked join targets on targets.lang = ranked.lang where nth <= target",
    ),
]
