"""Tables derived from the test tables, which hold no source code.

Each table is one SQL text over a test table that Spark and DuckDB both accept,
so that a query and its oracle start from the same rows.  Texts are built with
``concat`` and ``chr``; no literal holds a backslash or a quote.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_text(template: str, number: str) -> str:
    """A SQL expression for a text; ``{N}`` stands for the number."""
    parts = []
    for piece in re.split(r"(\{N\}|[\n\t\r\0'\\])", template):
        if piece == "{N}":
            parts.append(f"cast({number} as varchar(20))")
        elif piece in ("\n", "\t", "\r", "\0", "'", "\\"):
            parts.append(f"chr({ord(piece)})")
        elif piece:
            parts.append(f"'{piece}'")
    return f"concat({', '.join(parts)}, '')"


# extension and text of each kind of file
FILE_KINDS = (
    (".c", 'void f{N}(char *d, const char *s) {\n\tstrcpy(d, s);\n\tprintf("%s", d);\n}\n'),
    (".c", "int g{N}(size_t n) {\n\tchar *p = zip_malloc(n);\n\treturn zipMemcpy(p, n);\n}"),
    (
        ".h",
        "/* strcpy(a, b); */\nint h{N}(void) { callocated(); QStrcpy(); onestrcpytwo();"
        " return 0; }\n",
    ),
    (".c", 'int m{N}(void) {\n\tpopen_free(1);\n\treturn system("ls");\n}\n'),
    (
        ".cpp",
        'void q{N}(char *s) {\n\tstd::sprintf(s, "x");\n\tstd::malloc(4);\n\tdelete[] s;\n}\n',
    ),
    (".hpp", 'namespace n {\nbool w{N}() { return std::system("ls") == 0; }\n}\n'),
    (
        ".cc",
        "class K{N} {\npublic:\n\tvoid m() {\n\t\tif (x) {\n\t\t\tp->free(x); memset(a, 0, 4);"
        "\n\t\t}\n\t}\n};\n",
    ),
    (
        ".java",
        "class A{N} {\n\tvoid run(String s) throws Exception {\n\t\tRuntime.getRuntime().exec(s);"
        "\n\t\tst.executeQuery(s);\n\t\tst.executeBatch();\n\t}\n}\n",
    ),
    (
        ".java",
        'class B{N} {\n\tObject go() {\n\t\tMessageDigest.getInstance("MD5");\n\t\t'
        'MessageDigest.getInstance("SHA-256");\n\t\tin.readObject();\n\t\t'
        "return new XMLDecoder(in) == new ProcessBuilder(c).start();\n\t}\n}\n",
    ),
    (".py", 'import os\nos.system("ls {N}")\n'),
    (
        ".py",
        "def f{N}(c, q):\n\tc.execute(q)\n\tself.c.execute(q)\n\teval(q)\n\t# pickle.loads(q)\n"
        "\treturn yaml.load(q)\n\nf{N}(1, 2)\n",
    ),
    (".py", 'API_KEY = "AKIA{KEY}"\n'),
    (
        ".txt",
        "slack xoxb-1234567890{N}\r\n-----BEGIN RSA PRIVATE KEY-----\r\nend {N}\r\n",
    ),
    ("", "password = \"longenough1\"; token = \"alsolong22\"\nSecret: 'short'\n"),
    (
        ".c",
        'void s{N}(void) {\n\tputs("strcpy( {");\n\tfor (;;) {\n\t\tif (a) {\n\t\t\t'
        "memcpy(a, b, 1);\n\t\t}\n\t}\n}\n",
    ),
    (".bin", "head{N}\0tail"),
)

DIRECTORIES = ("src", "lib", "node_modules", ".git", "a/.hid", "venv", "__pycache__")


def _code_corpus() -> str:
    key = "p_partkey"
    texts, endings = [], []
    for kind, (ending, template) in enumerate(FILE_KINDS):
        text = sql_text(template, key).replace(
            "{KEY}", f"', lpad(cast({key} as varchar(20)), 16, '0'), '"
        )
        texts.append(f"when {kind} then {text}")
        endings.append(f"when {kind} then '{ending}'")
    folders = " ".join(f"when {i} then '{name}/'" for i, name in enumerate(DIRECTORIES))
    return f"""
select concat(case p_partkey % {len(DIRECTORIES)} {folders} end,
              cast(p_partkey as varchar(20)),
              case when p_partkey % {len(FILE_KINDS)} = 13 then '/.env'
                   else concat('/f', case p_partkey % {len(FILE_KINDS)} {' '.join(endings)} end)
              end) as path,
       case p_partkey % {len(FILE_KINDS)} {' '.join(texts)} end as text,
       cast(case p_partkey when 1 then 5242880 when 2 then 5242881
                 else p_partkey * 30011 % 10485761 end as bigint) as length
from part"""


def _policy_case(field: int) -> str:
    values = {
        "c": ("0.6", "0.52", "0.68"),
        "cpp": ("0.1", "0.02", "0.18"),
        "java": ("0.05", "0.011", "0.089"),
    }
    cases = " ".join(
        f"when '{lang}' then cast('{row[field]}' as double)" for lang, row in values.items()
    )
    return f"case lang {cases} end"


POLICY_SQL = {name: _policy_case(i) for i, name in enumerate(("threshold", "low", "high"))}

CODE_CORPUS = _code_corpus()

# everything with text in it, under one path scheme
TEXT_CORPUS = f"""
select concat('documents/', cast(doc_id as varchar(20))) as path, text from documents
union all
select concat('conversations/', cast(conv_id as varchar(20)), '/', cast(turn as varchar(20)))
       as path, text from conversations
union all
select concat('pages/', cast(page_id as varchar(20))) as path, html as text from pages
union all
select concat('code/', path) as path, text from ({CODE_CORPUS}) as code"""

# names around the edges of what counts as a wrapper of a known function
NAME_SHAPES = (
    "zip_memcpy", "do_strcpy_fast", "zipMemcpy", "quickStrCpy", "MallocTraced",
    "render_totals", "callocated", "freely_open", "onestrcpytwo", "ourStructCpy", "QStrcpy",
    "x{N}_free", "free{N}", "Free{N}", "a{N}Free", "Free_{N}", "ShellExecuteW", "run{N}System",
    "CALLOC{N}", "f{N}Snprintf", "exec_{N}_gets", "{N}", "aExecVp", "syslogX",
)


def _names() -> str:
    shapes = " ".join(
        f"when {i} then {sql_text(shape, 'p_partkey')}" for i, shape in enumerate(NAME_SHAPES)
    )
    return f"select case p_partkey % {len(NAME_SHAPES)} {shapes} end as name from part"


NAMES = _names()

# one candidate per order; scores hit every threshold and zone edge
SCORED_CANDIDATES = """
select cast(o_orderkey as varchar(20)) as candidate_id,
       concat('p', cast(o_orderkey % 97 as varchar(20)), '/f', cast(o_orderkey as varchar(20)),
              case o_orderkey % 5 when 0 then '.c' when 1 then '.cpp' when 2 then '.java'
                   when 3 then '.py' else '.hh' end) as path,
       case o_orderkey % 5 when 0 then 'c' when 1 then 'cpp' when 2 then 'java'
            when 3 then 'python' else 'C++ ' end as spelled,
       cast(o_orderkey % 400 + 1 as int) as line,
       cast(o_orderkey % 60 + 1 as int) as "column",
       case o_orderkey % 6 when 0 then 'strcpy' when 1 then 'strncpy' when 2 then 'snprintf'
            when 3 then 'delete' when 4 then 'system' else 'malloc' end as sink_name,
       case o_orderkey % 6 when 0 then 'CWE-120, CWE-787, CWE-125'
            when 1 then 'CWE-119, CWE-416, CWE-476' when 2 then 'CWE-134'
            when 3 then 'CWE-416, CWE-476' when 4 then 'CWE-78, CWE-88' else '' end as cwe_list,
       cast(o_orderkey % 6 + 1 as int) as rule_no,
       cast(o_orderkey * 37 % 1001 as double) / cast(1000 as double) as score
from orders"""

PAIRS = """
select concat('fn', cast(o_orderkey as varchar(20))) as func_name,
       case when o_orderkey % 13 = 0 then concat(' ', chr(9), chr(10))
            else concat('a', cast(o_orderkey as varchar(20))) end as func_src_before,
       case when o_orderkey % 11 = 0 then concat('a', cast(o_orderkey as varchar(20)))
            else concat('b', cast(o_orderkey as varchar(20))) end as func_src_after,
       concat('dir.d/f', case o_orderkey % 9 when 0 then '.c' when 1 then '.h' when 2 then '.cpp'
              when 3 then '.cc' when 4 then '.cxx' when 5 then '.hpp' when 6 then '.hh'
              when 7 then '.py' else '.java' end) as file_name,
       concat('cwe-', cast(o_orderkey % 4 as varchar(20))) as vul_type
from orders"""

LABELLED = """
select documents.doc_id as doc_id,
       case documents.lang when 'en' then 'c' when 'fr' then 'cpp' when 'de' then 'java'
            else 'other' end as lang,
       quality as label,
       cast(n_chars % 1001 as double) / cast(1000 as double) as score
from labels join documents on labels.doc_id = documents.doc_id"""

OLD_SNAPSHOT = """
select path, md5(text) as hash from code_corpus where length % 10 <> 0"""

NEW_SNAPSHOT = """
select path, md5(case when length % 4 = 0 then concat(text, '!') else text end) as hash
from code_corpus where length % 10 <> 1"""


def _view(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    # Spark quotes names with backticks where DuckDB uses double quotes
    return spark.sql(_spark_text(sql, tables), **tables)


def _spark_text(sql: str, tables: dict[str, DataFrame]) -> str:
    text = sql.replace('"column"', "`column`").replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)
        text = re.sub(rf"\b{name}\.", f"{{{name}}}.", text)
    return text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a small table out over all cores.

    Reading a file is cheap next to scanning it, and a small table may come in
    fewer splits than there are cores.  A table with enough splits is left as
    it is, so a large corpus is never exchanged.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def keys(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The columns a text is derived from, spread before it grows."""
    return spread(table(spark, folder, name).select(*columns))


def code_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, CODE_CORPUS, part=keys(spark, folder, "part", "p_partkey"))


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    columns = {
        "documents": ("doc_id", "text"),
        "conversations": ("conv_id", "turn", "text"),
        "pages": ("page_id", "html"),
        "part": ("p_partkey",),
    }
    return _view(
        spark, TEXT_CORPUS, **{name: keys(spark, folder, name, *c) for name, c in columns.items()}
    )


def names(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, NAMES, part=table(spark, folder, "part"))


def scored_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, SCORED_CANDIDATES, orders=keys(spark, folder, "orders", "o_orderkey"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, PAIRS, orders=table(spark, folder, "orders"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return _view(
        spark,
        LABELLED,
        labels=table(spark, folder, "labels"),
        documents=table(spark, folder, "documents"),
    )


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    corpus = code_corpus(spark, folder)
    return (
        _view(spark, OLD_SNAPSHOT, code_corpus=corpus),
        _view(spark, NEW_SNAPSHOT, code_corpus=corpus),
    )
