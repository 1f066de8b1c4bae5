"""Calls and function extents of a source file, found inside its own row.

A file becomes (1) a masked copy of the same length without comments, string
contents and directives, (2) an array of pieces that each end at a structural
character, and (3) the result of one fold over those pieces.  Every step is a
column expression, so scanning a corpus is a single map stage: no file is
shuffled, sorted or joined to itself, a hot path or directory does not matter,
and a lost task repeats only its own files.

The folds are SQL text rather than Column calls: each is one expression of some
hundred terms, and a plan is built much faster from text.

Text is handled as one character per UTF-8 byte (``bytes_as_chars``), so all
columns and extents count bytes.

What tokens cannot tell apart is listed in the README.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILLER = "\x01"  # stands for the inside of a string literal
NAME = r"[\w$\x80-\xFF]"

# Patterns avoid repeated groups over long input, which Java evaluates by
# recursion, and never give up after a long search, which would start again one
# character later.  A quoted literal ends at a quote after an even number of
# backslashes, or at the end of the line; an open comment at the end of the text.
_CLOSING = r"(?<!\\)(?:\\\\)*"
DOUBLE_QUOTED = rf'"[\s\S]*?{_CLOSING}(?:"|(?=\n)|\z)'
SINGLE_QUOTED = rf"'[\s\S]*?{_CLOSING}(?:'|(?=\n)|\z)"
# not the separator in a number
CHARACTER = rf"(?:(?<![0-9A-Fa-f])|(?<=u8)){SINGLE_QUOTED}"
BRACE_COMMENTS = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
LONG_QUOTED = (
    rf'"""[\s\S]*?{_CLOSING}(?:"""|\z)|\'\'\'[\s\S]*?{_CLOSING}(?:\'\'\'|\z)'
)
# outside comments and literals a # always starts a directive
_DIRECTIVE = r"#[\s\S]*?(?:(?<!\\)(?<!\\\r)(?=\n)|(?=/\*)|\z)"
_RAW_STRING = r'(?<=R)"([^()\\\s"]{0,16})\([\s\S]*?(?:\)\1"|\z)'

PIECES = {
    "c": rf"[^/\"'#]+|{_DIRECTIVE}|{BRACE_COMMENTS}|{DOUBLE_QUOTED}|{CHARACTER}|[\s\S]",
    "cpp": (
        rf"[^/\"'#]+|{_DIRECTIVE}|{BRACE_COMMENTS}|{_RAW_STRING}|{DOUBLE_QUOTED}|{CHARACTER}"
        r"|[\s\S]"
    ),
    "java": (
        rf'[^/\"\']+|{BRACE_COMMENTS}|"""[\s\S]*?{_CLOSING}(?:"""|\z)|{DOUBLE_QUOTED}|{CHARACTER}'
        r"|[\s\S]"
    ),
    "python": rf"[^#\"']+|#[^\n]*|{LONG_QUOTED}|{DOUBLE_QUOTED}|{SINGLE_QUOTED}|[\s\S]",
}

# a step ends with a structural character, or with a pair of brackets that
# holds none
STEPS = {
    "c": r"[^(){};]*(?:\([^(){};]*\)|[(){};])",
    "java": r"[^(){};]*(?:\([^(){};]*\)|[(){};])",
    "cpp": (
        r"[^(){};]*?(?:\bdelete\b|\((?![^(){};]*\bdelete\b)[^(){};]*\)|[(){};])"
    ),
    "python": r"[^()\[\]{}\n]*(?:\([^()\[\]{}\n]*\)|[()\[\]{}\n])",
}

# Words that may stand directly before a called name, and words
# that look like a call but are not one.
WORDS_BEFORE_CALL = (
    "return else case throw do goto co_return co_await co_yield and or not xor "
    "assert yield await delete instanceof in"
).split()
NOT_CALLED = {
    "brace": (
        "if for while switch catch return sizeof alignof alignas typeof decltype defined "
        "synchronized try this super noexcept throw static_assert __attribute__ __declspec "
        "operator requires new delete else do case"
    ).split(),
    "python": (
        "and or not in is if elif else while return yield lambda assert del raise await for "
        "with except import from def class async global nonlocal"
    ).split(),
}
CONTROL_HEADS = "if for while switch catch synchronized try do else return sizeof".split()
TRANSPARENT_HEADS = "noexcept throw __attribute__ __declspec alignas requires".split()
TYPE_WORD = r"\b(?:class|struct|union|enum|namespace|interface|extern)\b"
CHAIN = (
    rf"(?<!{NAME})(?:{NAME}++\s*+(?:\.|->|::)\s*+)*+{NAME}++(?=\s*$)"
)

# what may come before a function in its statement without being part of it
BEFORE_FUNCTION = (
    r"^\s*(?:\w+\s*:(?!:)\s*)*+(?:template\s*<(?:[^<>]++|<[^<>]*+>)*+>\s*)?"
    r'(?:extern\s*"[^"\n\s]*"?\s*)?'
)

CALL_TYPE = "struct<line:int,start_column:int,name:string,form:string,target:string,args:string>"
UNIT_TYPE = (
    f"struct<start_line:int,start_column:int,end_line:int,end_column:int,calls:array<{CALL_TYPE}>>"
)
POSITION_TYPE = "struct<line:int,col:int>"
OPENED_TYPE = f"struct<kind:string,head:string,at:{POSITION_TYPE}>"
SHAPE_TYPE = (
    "struct<name:string,before:string,word:string,link:string,scope:string,up_to_name:string,"
    "args:string>"
)
FORM_TYPE = "struct<form:string,target:string>"
BRACE_STEP_TYPE = f"struct<ends:string,text:string,run:string,head:string,shape:{SHAPE_TYPE}>"
BRACE_FACTS_TYPE = (
    f"struct<kind:string,pop:int,at:{POSITION_TYPE},next:{POSITION_TYPE},finished:boolean,"
    f"keep:boolean,found:{CALL_TYPE}>"
)
PYTHON_STEP_TYPE = f"struct<ends:string,text:string,run:string,shape:{SHAPE_TYPE}>"
PYTHON_FACTS_TYPE = "struct<is_code:boolean,indent:int,left:int,defines:boolean,found:%s>" % CALL_TYPE
FUNCTION_TYPE = (
    f"struct<start_line:int,start_column:int,full:array<array<{CALL_TYPE}>>,"
    f"recent:array<{CALL_TYPE}>>"
)
NO_CALLS = f"cast(array() as array<{CALL_TYPE}>)"
NO_UNITS = f"cast(array() as array<{UNIT_TYPE}>)"
NO_CALL_BLOCKS = f"cast(array() as array<array<{CALL_TYPE}>>)"
NO_UNIT_BLOCKS = f"cast(array() as array<array<{UNIT_TYPE}>>)"
SCAN_TYPE = f"struct<units:array<{UNIT_TYPE}>,loose:array<{CALL_TYPE}>>"
BLOCK = 64
STEPS_AT_ONCE = 256

BRACE_LANGUAGES = ("c", "cpp", "java")
LANGUAGES = (*BRACE_LANGUAGES, "python")


def _text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _any(column: str, words: list[str] | tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(_text(word) for word in words)})"


def _let(value: str, name: str, body: str, result: str) -> str:
    """Evaluate ``value`` once and use it by name in ``body``, whose type is
    ``result``.

    A fold over one element does this cheapest: ``transform(...)[0]`` copies
    what it returns and derives its type again for every row.
    """
    return f"aggregate(array({value}), cast(null as {result}), (z, {name}) -> {body})"


def _lets(bindings: dict[str, str], body: str, result: str) -> str:
    """Nested ``_let``: later values may use earlier names."""
    for name, value in reversed(bindings.items()):
        body = _let(value, name, body, result)
    return body


def _then(facts: str, state: str) -> str:
    """The next ``state`` of a fold from ``s`` and some facts ``f``."""
    return f"aggregate(array({facts}), s, (s, f) -> {state})"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _by_language(texts: dict[str, str], otherwise: str) -> str:
    cases = " ".join(f"when {_text(lang)} then {sql}" for lang, sql in texts.items())
    return f"case lang {cases} else {otherwise} end"


def _blank(piece: str, filler: str) -> str:
    return (
        f"if(instr({piece}, '\\n') = 0, repeat('{filler}', length({piece})),"
        f" regexp_replace({piece}, '[^\\n]', '{filler}'))"
    )


def _mask(code: str, lang: str) -> str:
    """The code with everything that is not code blanked out, length kept."""
    pieces = f"regexp_extract_all({code}, {_text(PIECES[lang])}, 0)"
    quoted = "first in ('\"', '\\'') and length(p) > 1"
    inside = f"concat(first, {_blank('substr(p, 2)', FILLER)})"
    if lang == "python":
        masked = f"case when first = '#' then {_blank('p', ' ')} when {quoted} then {inside} else p end"
    else:
        directive = f"when first = '#' then {_blank('p', ' ')}" if lang != "java" else ""
        # a literal of one word stays readable: rules may ask for its value
        masked = (
            f"case when left(p, 2) in ('//', '/*') then {_blank('p', ' ')} {directive}"
            f""" when first = '"' and p rlike {_text('^"[\\w-]*"$')} then p"""
            f" when {quoted} then {inside} else p end"
        )
    return f"array_join(transform({pieces}, p -> {_let('left(p, 1)', 'first', masked, 'string')}), '')"


def _filled(full: str, recent: str) -> str:
    """Lists that grow are kept as full blocks and a recent one, because adding
    to an array copies it: here the blocks once an item no longer fits ..."""
    return f"if(size({recent}) >= {BLOCK}, concat({full}, array({recent})), {full})"


def _added(recent: str, items: str) -> str:
    """... and here the recent block with the items."""
    return f"if(size({recent}) >= {BLOCK}, {items}, concat({recent}, {items}))"


def _newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, '\\n', '')))"


def _after(line: str, col: str, text: str) -> str:
    """Position reached after some text."""
    moved = _struct(
        line=f"{line} + breaks",
        col=f"if(breaks = 0, {col} + length({text}), length(substring_index({text}, '\\n', -1)))",
    )
    return _let(_newlines(text), "breaks", moved, POSITION_TYPE)


def _trimmed(text: str) -> str:
    return f"trim(trailing ' \\t\\n\\r\\u000C\\u000B' from {text})"


def _squeeze(text: str) -> str:
    return f"translate({text}, ' \\t\\n\\r\\u000C\\u000B', '')"


LAST_NAME = (
    f"if(chain rlike '[.:>]', regexp_extract(chain, {_text(NAME + '+$')}, 0), chain)"
)

# what the text before an opening bracket says about a call
_SHAPE = _let(
    _trimmed(f"regexp_replace(run, {_text(CHAIN + r'\s*$')}, '')"),
    "before",
    _struct(
        name="name",
        before="before",
        word=f"regexp_extract(before, {_text(rf'(?<!{NAME}){NAME}++$')}, 0)",
        link=f"regexp_extract(chain, {_text(rf'(\.|->|::)\s*{NAME}+$')}, 1)",
        scope=f"regexp_replace({_squeeze(f'regexp_replace(chain, {_text(NAME + "+$")}, {_text("")})')},"
        f" {_text(r'(?:\.|->|::)$')}, '')",
        up_to_name=f"regexp_replace(run, {_text(NAME + r'+\s*$')}, '')",
        args="args",
    ),
    SHAPE_TYPE,
)


def _form(family: str, closed: str) -> str:
    """(form, target) of the call in ``e.shape``; no form means no call."""
    declared = "h.word in ('def', 'class')"
    if family == "brace":
        declared = f"h.word <> '' and not {_any('h.word', WORDS_BEFORE_CALL)}"
    is_new = "h.word = 'new' and h.link <> '::'" if family == "brace" else "false"
    form = f"""
case when {_any('h.name', NOT_CALLED[family])} then null
     when dotted or h.link in ('.', '->') then 'member'
     when {is_new} then 'new'
     when {declared} or endswith(h.before, '@') then null
     when scoped or h.link = '::' then 'scoped'
     else 'call' end"""
    target = f"""
case when dotted and h.scope = ''
       then if(h.before in ('.', '->') and {closed} <> '', concat({closed}, '()'), '?')
     when dotted then concat('?.', h.scope)
     when scoped and h.scope = '' then case
       when h.before rlike {_text(r'::\s*\w+\s*<[^<>]*>\s*::$')} then '?::?'
       when h.before rlike {_text(r'>\s*::$')} then '?'
       else '' end
     when scoped then concat('::', h.scope)
     else h.scope end"""
    return _lets(
        {
            "h": "e.shape",
            "dotted": f"h.before rlike {_text(r'(?:\.|->)$')}",
            "scoped": "endswith(h.before, '::')",
        },
        _struct(form=form, target=target),
        FORM_TYPE,
    )


def _hit(names: dict[str, str] | None) -> str:
    """Whether a called name is wanted in its language."""
    if names is None:
        return "name <> ''"
    tests = {lang: f"name rlike {_text(pattern)}" for lang, pattern in names.items()}
    return f"name <> '' and {_by_language(tests, 'false')}"


def _brace_steps(masked: str, names: dict[str, str] | None) -> str:
    """Stateless facts about each step, computed once."""
    # the mark added at the end lets the last step end, too
    cut = _by_language(
        {"cpp": f"regexp_extract_all(concat(masked, ';'), {_text(STEPS['cpp'])}, 0)"},
        f"regexp_extract_all(concat(masked, ';'), {_text(STEPS['c'])}, 0)",
    )
    creates = rf"\b(?:new|record)\s+{CHAIN}"
    head = f"""
case when chain = '' then if(run rlike {_text(r'\boperator\s*[^\w\s]{1,3}\s*$')}, 'operator', '')
     when (contains(run, 'new') or contains(run, 'record')) and run rlike {_text(creates)}
       then concat('new ', {_squeeze('chain')})
     else {_squeeze('chain')} end"""
    # the text after the bracket up to the next structural character
    args = (
        "if(endswith(t, '('),"
        f" coalesce(regexp_extract(get(steps, i + 1), {_text('^[^(){};]*')}, 0), ''),"
        " substr(t, length(run) + 2, length(t) - length(run) - 2))"
    )
    opening = _lets(
        {
            "run": "substring_index(t, '(', 1)",
            "chain": f"regexp_extract(run, {_text(CHAIN)}, 0)",
            "name": LAST_NAME,
        },
        _struct(
            ends="if(endswith(t, '('), '(', 'pair')",
            text="t",
            run="run",
            head=head,
            shape=f"if({_hit(names)}, {_let(args, 'args', _SHAPE, SHAPE_TYPE)}, null)",
        ),
        BRACE_STEP_TYPE,
    )
    plain = _struct(
        ends="if(endswith(t, 'e'), 'delete', right(t, 1))",
        text="t",
        run="if(endswith(t, 'e'), left(t, length(t) - 6), left(t, length(t) - 1))",
        head="''",
        shape="null",
    )
    return _lets(
        {"masked": masked, "steps": cut},
        f"transform(steps, (t, i) -> if(contains(t, '('), {opening}, {plain}))",
        f"array<{BRACE_STEP_TYPE}>",
    )


# State of the fold over a brace language.  ``here`` is the position reached,
# ``at`` where the statement began, ``closed`` the text before the bracket that
# was closed last; ``opened`` is the stack of open brackets; ``functions`` the
# stack of open functions with the calls seen in each; ``waiting`` the calls of
# the current statement, which belong to a function the statement may turn out
# to open; ``units`` the finished functions; ``loose`` the calls outside any.
_BRACE_START = _struct(
    here="named_struct('line', 1, 'col', 0)",
    at="named_struct('line', 1, 'col', 0)",
    begins="true",
    last="''",
    closed="''",
    opened=f"cast(array() as array<{OPENED_TYPE}>)",
    functions=f"cast(array() as array<{FUNCTION_TYPE}>)",
    waiting=NO_CALLS,
    units=NO_UNITS,
    loose=NO_CALLS,
)

_TOP = "try_element_at(s.opened, -1)"
_OUTSIDE = f"(size(s.opened) = 0 or {_TOP}.kind = 'type')"

_OPENS_FUNCTION = f"""
s.last = ')' and s.closed <> '' and {_OUTSIDE}
and not startswith(s.closed, 'new ') and not {_any('s.closed', CONTROL_HEADS)}
and not contains(e.run, '=') and not e.run rlike {_text(TYPE_WORD)}"""

_OPENS_TYPE = f"""
not contains(e.run, '=')
and ((s.last = ')' and startswith(s.closed, 'new ')) or e.run rlike {_text(TYPE_WORD)})"""

_KIND = f"""
case e.ends when '(' then '('
  when '{{' then if({_OPENS_FUNCTION}, 'function', if({_OPENS_TYPE}, 'type', 'block')) end"""

# a typed prefix where only declarations stand is a declaration
_DECLARES = f"""
s.begins and e.shape.before <> '' and {_OUTSIDE} and not contains(e.run, '=')
and not e.shape.before rlike {_text(r'(?:\.|->)$|^\s*::$')}
and not {_any('e.shape.word', ['new', *WORDS_BEFORE_CALL])}"""

# an unmatched parenthesis never outlives the braces around it
_POP = f"""
case e.ends when ')' then if({_TOP}.kind = '(', size(s.opened), null)
  when '}}' then if({_TOP}.kind <> '(', size(s.opened),
    array_max(transform(s.opened, (o, i) -> if(o.kind <> '(', i + 1, null)))) end"""

_FOUND = f"""
case when e.shape is not null and not ({_DECLARES}) then {_let(
    _form("brace", "if(s.last = ')', s.closed, '')"),
    "call",
    "if(call.form is null, null, "
    + _let(
        _after("s.here.line", "s.here.col", "e.shape.up_to_name"),
        "place",
        _struct(
            line="place.line",
            start_column="place.col + 1",
            name="e.shape.name",
            form="call.form",
            target="call.target",
            args="e.shape.args",
        ),
        CALL_TYPE,
    )
    + ")",
    CALL_TYPE,
)}
     when e.ends = 'delete' and not e.run rlike {_text(r'(?:=|operator)\s*$')} then {_let(
    _after("s.here.line", "s.here.col", "e.run"),
    "place",
    _struct(
        line="place.line",
        start_column="place.col + 1",
        name="'delete'",
        form="'keyword'",
        target="''",
        args="''",
    ),
    CALL_TYPE,
)} end"""

_BRACE_FACTS = _let(
    _POP,
    "pop",
    _struct(
        kind=_KIND,
        pop="pop",
        at="if(s.begins, "
        + _after("s.here.line", "s.here.col", f"regexp_extract(e.run, {_text(BEFORE_FUNCTION)}, 0)")
        + ", s.at)",
        next=_after("s.here.line", "s.here.col", "e.text"),
        finished="e.ends = '}' and coalesce(try_element_at(s.opened, pop).kind = 'function', false)",
        keep="e.ends = '}' and"
        " coalesce(try_element_at(s.opened, nullif(pop - 1, 0)).kind = '(', false)",
        found=_FOUND,
    ),
    BRACE_FACTS_TYPE,
)

_CURRENT = "try_element_at(s.functions, -1)"
_OUTER = "slice(s.functions, 1, greatest(size(s.functions) - 1, 0))"
_FLUSH = "size(s.waiting) > 0 and e.ends in (';', '{', '}')"
_UNIT = _struct(
    start_line=f"{_CURRENT}.start_line",
    start_column=f"{_CURRENT}.start_column",
    end_line="f.next.line",
    end_column="f.next.col",
    calls=f"concat(flatten({_CURRENT}.full), {_CURRENT}.recent, s.waiting)",
)
_LOOSE = f"{_FLUSH} and size(s.functions) = 0 and coalesce(f.kind, '') <> 'function'"
_HEAD = (
    f"if(s.last = ')' and ({_any('e.head', TRANSPARENT_HEADS)}"
    f" or e.run rlike {_text(r'^\s*$')}), s.closed, e.head)"
)

_BRACE_NEXT = _struct(
    here="f.next",
    at="if(f.keep, try_element_at(s.opened, f.pop).at, f.at)",
    begins="e.ends in (';', '{', '}') and not f.keep",
    last="if(e.ends = 'pair', ')', e.ends)",
    closed=f"""
case e.ends when 'pair' then {_HEAD}
  when ')' then if(f.pop is null, '', try_element_at(s.opened, f.pop).head)
  else '' end""",
    opened=f"""
case when f.pop is not null then slice(s.opened, 1, f.pop - 1)
     when f.kind is not null
       then concat(s.opened, array({_struct(kind="f.kind", head=_HEAD, at="f.at")}))
     else s.opened end""",
    functions=f"""
case when f.finished then {_OUTER}
     when f.kind = 'function' then concat(s.functions, array({_struct(
    start_line="f.at.line",
    start_column="f.at.col",
    full=NO_CALL_BLOCKS,
    recent="s.waiting",
)}))
     when {_FLUSH} and size(s.functions) > 0 then concat({_OUTER}, array({_struct(
    start_line=f"{_CURRENT}.start_line",
    start_column=f"{_CURRENT}.start_column",
    full=_filled(f"{_CURRENT}.full", f"{_CURRENT}.recent"),
    recent=_added(f"{_CURRENT}.recent", "s.waiting"),
)}))
     else s.functions end""",
    waiting=f"""
case when f.found is not null then concat(s.waiting, array(f.found))
     when {_FLUSH} then {NO_CALLS}
     else s.waiting end""",
    units=f"if(f.finished, concat(s.units, array({_UNIT})), s.units)",
    loose=f"if({_LOOSE}, concat(s.loose, s.waiting), s.loose)",
)

_BRACE_STEP = _then(_BRACE_FACTS, _BRACE_NEXT)

_BRACE_END = _struct(
    units="flatten(o.units)",
    loose="concat(flatten(o.loose),"
    " flatten(transform(o.s.functions, u -> concat(flatten(u.full), u.recent))), o.s.waiting)",
)


def _python_steps(masked: str, names: dict[str, str] | None) -> str:
    opening = _lets(
        {
            "run": "substring_index(t, '(', 1)",
            "chain": f"regexp_extract(run, {_text(CHAIN)}, 0)",
            "name": LAST_NAME,
            "args": "''",
        },
        _struct(
            ends="if(endswith(t, '('), '(', 'pair')",
            text="t",
            run="run",
            shape=f"if({_hit(names)}, {_SHAPE}, null)",
        ),
        PYTHON_STEP_TYPE,
    )
    plain = _struct(ends="right(t, 1)", text="t", run="left(t, length(t) - 1)", shape="null")
    # the line added at the end changes no extent
    cut = f"regexp_extract_all(concat({masked}, '\\n'), {_text(STEPS['python'])}, 0)"
    return f"transform({cut}, t -> if(contains(t, '('), {opening}, {plain}))"


# State of the fold over Python.  A function ends with the last code before a
# logical line that is indented no deeper than its ``def``.
_PYTHON_START = _struct(
    line="1",
    col="0",
    depth="0",
    begins="true",
    end_line="1",
    end_col="0",
    functions="cast(array() as array<struct<indent:int,start_line:int,start_column:int,"
    f"full:array<array<{CALL_TYPE}>>,recent:array<{CALL_TYPE}>>>)",
    units=NO_UNITS,
    loose=NO_CALLS,
)


def _ended(functions: str, state: str = "s") -> str:
    unit = _struct(
        start_line="u.start_line",
        start_column="u.start_column",
        end_line=f"{state}.end_line",
        end_column=f"{state}.end_col",
        calls="concat(flatten(u.full), u.recent)",
    )
    return f"transform({functions}, u -> {unit})"


_INDENT = (
    f"length(replace(regexp_extract(e.run, {_text(r'^[ \t\f]*')}, 0), '\\t', '        '))"
)
_PYTHON_FOUND = f"if(e.shape is null, null, {_let(
    _form('python', _text('')),
    'call',
    'if(call.form is null, null, ' + _struct(
        line='s.line',
        start_column='s.col + length(e.shape.up_to_name) + 1',
        name='e.shape.name',
        form='call.form',
        target='call.target',
        args=_text(''),
    ) + ')',
    CALL_TYPE,
)})"
_IS_CODE = f"(e.ends <> '\\n' or e.run rlike {_text(r'\S')})"
_PYTHON_FACTS = _let(
    f"if(s.begins and {_IS_CODE} and not startswith(e.run, '{FILLER}'), {_INDENT}, null)",
    "indent",
    _struct(
        is_code=_IS_CODE,
        indent="indent",
        # deeper functions were opened later, so those left are the first ones
        left="if(indent is null or size(s.functions) = 0, size(s.functions),"
        " size(filter(s.functions, u -> u.indent < indent)))",
        defines="indent is not null and contains(e.run, 'def')"
        f" and e.run rlike {_text(r'^\s*(?:async\s+)?def\s')}",
        found=_PYTHON_FOUND,
    ),
    PYTHON_FACTS_TYPE,
)
_HERE = "try_element_at(s.functions, nullif(f.left, 0))"
_LEFT = "if(f.left = size(s.functions), s.functions, slice(s.functions, 1, f.left))"
_NONE_ENDED = "f.left = size(s.functions)"
_NOW_ENDED = _ended("slice(s.functions, f.left + 1, size(s.functions) - f.left)")
_NOT_LOOSE = "f.found is null or f.left > 0"
_PYTHON_NEXT = _struct(
    line="if(e.ends = '\\n', s.line + 1, s.line)",
    col="if(e.ends = '\\n', 0, s.col + length(e.text))",
    depth="""
case when e.ends in ('\\n', 'pair') then s.depth
     when e.ends in ('(', '[', '{') then s.depth + 1
     else greatest(s.depth - 1, 0) end""",
    begins="e.ends = '\\n' and s.depth = 0 and not endswith(e.run, '\\\\')",
    end_line="if(f.is_code, s.line, s.end_line)",
    end_col="""
case when not f.is_code then s.end_col
     when e.ends = '\\n' then s.col + length(%s)
     else s.col + length(e.text) end"""
    % _trimmed("e.run"),
    functions=f"""
case when f.defines then concat({_LEFT}, array({_struct(
    indent="f.indent",
    start_line="s.line",
    start_column=f"length(regexp_extract(e.run, {_text(r'^\s*')}, 0))",
    full=NO_CALL_BLOCKS,
    recent=NO_CALLS,
)}))
     when f.found is not null and f.left > 0 then concat(slice(s.functions, 1, f.left - 1), array({
    _struct(
        indent=f"{_HERE}.indent",
        start_line=f"{_HERE}.start_line",
        start_column=f"{_HERE}.start_column",
        full=_filled(f"{_HERE}.full", f"{_HERE}.recent"),
        recent=_added(f"{_HERE}.recent", "array(f.found)"),
    )}))
     else {_LEFT} end""",
    units=f"if({_NONE_ENDED}, s.units, concat(s.units, {_NOW_ENDED}))",
    loose=f"if({_NOT_LOOSE}, s.loose, concat(s.loose, array(f.found)))",
)
_PYTHON_STEP = _then(_PYTHON_FACTS, _PYTHON_NEXT)
_PYTHON_END = _struct(
    units=f"concat(flatten(o.units), {_ended('o.s.functions', 'o.s')})",
    loose="flatten(o.loose)",
)
_BRACE_FIELDS = "here at begins last closed opened functions waiting".split()
_PYTHON_FIELDS = "line col depth begins end_line end_col functions".split()


def _fold(steps: str, start: str, fields: list[str], step: str, end: str) -> str:
    """Fold over the steps, some at a time.

    Spark copies the state after every step, so what was found is taken out of
    it after each stretch of steps, and the state stays small.
    """
    stretch = f"aggregate(slice(steps, first, {STEPS_AT_ONCE}), o.s, (s, e) -> {step})"
    state = _struct(**{f: f"r.{f}" for f in fields}, units=NO_UNITS, loose=NO_CALLS)
    taken = _struct(
        s=state,
        units="if(size(r.units) > 0, concat(o.units, array(r.units)), o.units)",
        loose="if(size(r.loose) > 0, concat(o.loose, array(r.loose)), o.loose)",
    )
    outer = _struct(s=start, units=NO_UNIT_BLOCKS, loose=NO_CALL_BLOCKS)
    following = f"aggregate(array({stretch}), o, (o, r) -> {taken})"
    firsts = f"if(size(steps) > 0, sequence(1, size(steps), {STEPS_AT_ONCE}), array(1))"
    return _let(
        steps,
        "steps",
        f"aggregate({firsts}, {outer}, (o, first) -> {following}, o -> {end})",
        SCAN_TYPE,
    )


def scan_code(names: dict[str, str] | None = None, langs: tuple[str, ...] = LANGUAGES) -> Column:
    """Struct of ``units`` (functions with their extent and calls) and
    ``loose`` (calls outside functions), from the columns ``code`` and ``lang``.

    ``names`` keeps only the calls whose name matches the pattern of their
    language; by default all are kept.
    """
    scans = {}
    braced = [lang for lang in BRACE_LANGUAGES if lang in langs]
    if braced:
        masked = _by_language({lang: _mask("code", lang) for lang in braced}, "null")
        steps = _brace_steps(masked, names)
        fold = _fold(steps, _BRACE_START, _BRACE_FIELDS, _BRACE_STEP, _BRACE_END)
        scans.update({"brace": f"when {_any('lang', braced)} then {fold}"})
    if "python" in langs:
        steps = _python_steps(_mask("code", "python"), names)
        fold = _fold(steps, _PYTHON_START, _PYTHON_FIELDS, _PYTHON_STEP, _PYTHON_END)
        scans.update({"python": f"when lang = 'python' then {fold}"})
    return F.expr(f"case {' '.join(scans.values())} end")


def extent(lines: Column, unit: Column) -> Column:
    """Text of a unit, cut out of the lines of its file."""
    first, last = unit["start_line"], unit["end_line"]
    head = F.substr(F.element_at(lines, first), unit["start_column"] + 1)
    tail = F.left(F.element_at(lines, last), unit["end_column"])
    inner = F.slice(lines, first + 1, F.greatest(last - first - 1, F.lit(0)))
    return F.when(
        first == last,
        F.substr(
            F.element_at(lines, first),
            unit["start_column"] + 1,
            unit["end_column"] - unit["start_column"],
        ),
    ).otherwise(F.array_join(F.concat(F.array(head), inner, F.array(tail)), "\n"))
