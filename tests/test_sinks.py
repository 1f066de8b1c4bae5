"""Candidates, calls and extents on small sources written for these tests."""

import pytest
from pyspark.sql import functions as F

from vettica.functions.sink_rules import SINK_RULES, SinkRule, rules_table
from vettica.operators import sinks
from vettica.operators.tokens import code_tokens

C_SOURCE = """\
/* gets(x); ỗ */ #include <stdio.h>
#define COPY(a, b) \\
    strcpy(a, b)
static int
read_all(char *into,
         const char *from)
{
    int n = /* ỗ */ sprintf(into, "%s: gets(%d) {", from, 1);
    for (int i = 0; i < n; i++) {
        if (from[i] == '{' || from[i] == '\\'') { my_free(into); }
    }
    return p->free(n) + (int) memcpy(into, from, n);
}
void *malloc_all(unsigned n);
char *strcpy(char *a, const char *b);
int first = alloca(3);
struct pair { int a; } one = { 1 };
int last(void) { system("a" "b"); }
"""

CPP_SOURCE = """\
template <typename T> class Box : public Base<T> {
public:
    Box(int n) : data(std::malloc(n)), size(n) { ::printf("%d", n); }
    Box(const Box &) = delete;
    void operator delete(void *p);
    ~Box() { delete[] data; delete this; }
    auto run() const -> int { auto f = [&](int x) { return a::b::system("x") + std::system("y"); }; return f(1); }
    bool operator==(const Box &o) { return memcmp(a, o.a) == 0 && std::strcpy(x, y); }
};
const char *raw = R"x(gets(1); )" gets(2) { )x";
int main() { printf("%d", 1'000'000); }
"""

JAVA_SOURCE = """\
@Service({"a", "b"})
public class Store {
    @Override
    public List<String> execute(String q) throws SqlException, Other {
        Runtime.getRuntime().exec(q);
        java.lang.Runtime.getRuntime().exec(q);
        new ProcessBuilder(List.of(q)).start();
        other().start();
        (ObjectInputStream) in.readObject();
        this.in.readObject();
        MessageDigest.getInstance("SHA1", "X");
        MessageDigest.getInstance("SHA-256");
        run(new Task() {
            public void go() { statement.executeUpdate("x"); }
        });
        return new XMLDecoder(in).readObject();
    }
    Store() { execute("q"); }
    Object lazy = new java.beans.XMLDecoder(in);
}
"""

PYTHON_SOURCE = '''\
import os, subprocess
@decorate(eval("1"))
async def outer(
    a,
    b=eval("2"),
):
    """doc os.system("no")
at the margin os.system("no")
"""
    def inner():
        return os.system("x")  # os.system("no")

    x = """
""" + str(pickle.loads(a))
    self.cur.execute(a); cur.execute(b)
    return subprocess.run(
[a], shell=False)

# trailing
subprocess . Popen(["a"])
class A:
    def exec(self): yaml.load(x); return exec("y")
'''


def found(corpus, path, source, **options):
    rows = sinks.sink_candidates(corpus({path: source}), **options).collect()
    return {(r.line, r.column, r.sink_name, r.rule_no): r for r in rows}


def test_c_candidates(corpus):
    rows = found(corpus, "a/b.c", C_SOURCE)
    assert sorted(rows) == [
        (8, 23, "sprintf", 1),
        (10, 50, "my_free", 2),
        (12, 31, "memcpy", 2),
        (16, 13, "alloca", 2),
        (18, 18, "system", 4),
    ]
    body = C_SOURCE[C_SOURCE.index("static int") : C_SOURCE.index("\nvoid *malloc_all")]
    assert rows[8, 23, "sprintf", 1].snippet == body
    assert rows[16, 13, "alloca", 2].snippet == "int first = alloca(3);"
    assert rows[18, 18, "system", 4].snippet == 'int last(void) { system("a" "b"); }'
    assert rows[8, 23, "sprintf", 1].cwe == ["CWE-120", "CWE-787", "CWE-125"]


def test_cpp_candidates(corpus):
    rows = found(corpus, "a/b.cc", CPP_SOURCE)
    names = [(line, name, rule) for line, _, name, rule in sorted(rows)]
    assert names == [
        (3, "printf", 7),
        (6, "delete", 5),
        (6, "delete", 5),
        (7, "system", 9),
        (8, "strcpy", 2),
        (11, "printf", 6),
    ]
    texts = {(line, name): row.snippet for (line, _, name, _), row in rows.items()}
    lines = CPP_SOURCE.split("\n")
    for key in texts:
        assert texts[key] == lines[key[0] - 1].strip()


def test_java_candidates(corpus):
    rows = found(corpus, "Store.java", JAVA_SOURCE)
    names = [(line, name, rule) for line, _, name, rule in sorted(rows)]
    assert names == [
        (5, "exec", 1),
        (7, "start", 2),
        (9, "readObject", 4),
        (11, "getInstance", 6),
        (14, "executeUpdate", 3),
        (16, "XMLDecoder", 5),
        (18, "execute", 3),
    ]
    by_line = {line: row for (line, *_), row in rows.items()}
    lines = JAVA_SOURCE.split("\n")
    assert by_line[5].snippet == "\n".join(lines[2:17]).strip()
    assert by_line[14].snippet == lines[13].strip()
    assert by_line[18].snippet == 'Store() { execute("q"); }'
    assert {row.cwe == [] for row in rows.values()} == {True}


def test_python_candidates(corpus):
    rows = found(corpus, "x.py", PYTHON_SOURCE)
    names = [(line, name, rule) for line, _, name, rule in sorted(rows)]
    assert names == [
        (2, "eval", 3),
        (5, "eval", 3),
        (11, "system", 1),
        (14, "loads", 4),
        (15, "execute", 6),
        (16, "run", 2),
        (20, "Popen", 2),
        (22, "load", 5),
        (22, "exec", 3),
    ]
    by_line = {line: row for (line, *_), row in rows.items()}
    lines = PYTHON_SOURCE.split("\n")
    assert by_line[2].snippet == '@decorate(eval("1"))'
    assert by_line[5].snippet == "\n".join(lines[2:17])
    assert by_line[11].snippet == 'def inner():\n        return os.system("x")'
    assert by_line[20].snippet == 'subprocess . Popen(["a"])'
    assert by_line[22].snippet == 'def exec(self): yaml.load(x); return exec("y")'


def test_call_outside_functions_keeps_its_line(corpus):
    (row,) = found(corpus, "t.py", 'import os\n  os.system("ls")  \n').values()
    assert row.snippet == 'os.system("ls")' and row.function_line is None


@pytest.mark.parametrize(
    "name,groups",
    [
        ("zip_memcpy", {2}),
        ("do_strcpy_fast", {1}),
        ("zipMemcpy", {2}),
        ("quickStrCpy", {1}),
        ("MallocTraced", {5}),
        ("popen_free", {2, 4}),
        ("render_totals", set()),
        ("callocated", set()),
        ("freely_open", set()),
        ("onestrcpytwo", set()),
        ("ourStructCpy", set()),
        ("QStrcpy", set()),
    ],
)
def test_wrapper_names(corpus, name, groups):
    rows = found(corpus, "w.c", f"void use(void) {{\n    {name}(a, b);\n}}\n")
    assert {rule for *_, rule in rows} == groups


def test_files_without_a_rule_language_are_left_out(corpus):
    files = {"notes.txt": "strcpy(a, b);", "a.C": "strcpy(a, b);", "empty.c": "", ".c": "gets(a);"}
    assert sinks.sink_candidates(corpus(files)).count() == 0


def test_duplicate_rules_and_files_are_kept(corpus):
    files = {f"d{i}/same.c": "int f() { popen_free(1); }" for i in range(3)}
    assert sinks.sink_candidates(corpus(files)).count() == 6


def test_rules_are_data(spark, corpus):
    table = rules_table(spark)
    assert table.count() == 27
    files = corpus({
        "a.c": "void f(char *a) { strcpy(a, a); system(a); }\nint x = free(p);",
        "b.py": "import os\ndef g(q):\n    os.system(q)\n    eval(q)\n",
        "c.java": 'class A { void m() { MessageDigest.getInstance("MD5"); rt.exec(c); } }',
    })
    literal, joined = (sorted(map(str, sinks.sink_candidates(files, r).collect())) for r in (SINK_RULES, table))
    assert literal == joined and len(literal) > 4
    mine = (SinkRule("c", 1, "call", "^danger", cwe=("CWE-1",)),)
    rows = found(corpus, "a.c", "void f() { dangerous(1); strcpy(a, b); }", rules=mine)
    assert [(r.sink_name, r.cwe) for r in rows.values()] == [("dangerous", ["CWE-1"])]


def test_a_large_rules_table_is_joined(spark, corpus):
    many = spark.range(20_000).selectExpr(
        "'c' as lang", "cast(id as int) as rule_no", "'call' as form", "concat('^risky', id, '$') as name",
        "cast(null as string) as target", "'' as args", "array('CWE-1') as cwe",
    )
    rows = sinks.sink_candidates(corpus({"a.c": "void f() { risky7(1); risky19999(2); safe(3); }"}), many).collect()
    assert sorted((r.sink_name, r.rule_no) for r in rows) == [("risky19999", 19999), ("risky7", 7)]


def test_call_forms(corpus):
    rows = sinks.call_sites(
        corpus(
            {
                "a.cpp": "int f() { a(); b.c(); d->e(); g::h(); ::i(); new J(); sizeof(k); if (l()) m(n()); o<int>::p(); q::r<int>::s(); t::u::v(); }",
                "b.py": "def f(): a(); b.c(); d().e()\n",
            }
        )
    ).collect()
    forms = {(r.path, r.name): (r.form, r.target) for r in rows}
    assert forms == {
        ("a.cpp", "a"): ("call", ""),
        ("a.cpp", "c"): ("member", "b"),
        ("a.cpp", "e"): ("member", "d"),
        ("a.cpp", "h"): ("scoped", "g"),
        ("a.cpp", "i"): ("scoped", ""),
        ("a.cpp", "J"): ("new", ""),
        ("a.cpp", "l"): ("call", ""),
        ("a.cpp", "m"): ("call", ""),
        ("a.cpp", "n"): ("call", ""),
        ("a.cpp", "p"): ("scoped", "?"),
        ("a.cpp", "s"): ("scoped", "?::?"),
        ("a.cpp", "v"): ("scoped", "t::u"),
        ("b.py", "a"): ("call", ""),
        ("b.py", "c"): ("member", "b"),
        ("b.py", "d"): ("call", ""),
        ("b.py", "e"): ("member", "?"),
    }


def test_function_spans(corpus):
    rows = sinks.function_spans(corpus({"a.c": C_SOURCE, "S.java": JAVA_SOURCE})).collect()
    spans = sorted((r.path, r.start_line, r.start_column, r.end_line, r.end_column) for r in rows)
    assert spans == [
        ("S.java", 3, 5, 17, 5),
        ("S.java", 14, 13, 14, 62),
        ("S.java", 18, 5, 18, 29),
        ("a.c", 4, 1, 13, 1),
        ("a.c", 18, 1, 18, 35),
    ]


def test_tokens_are_the_text(corpus):
    files = {"a.c": C_SOURCE, "b.cpp": CPP_SOURCE, "S.java": JAVA_SOURCE, "p.py": PYTHON_SOURCE, "e.c": ""}
    rows = code_tokens(corpus(files)).collect()
    for path, source in files.items():
        tokens = sorted((r.token_no, r) for r in rows if r.path == path)
        assert "".join(r.token for _, r in tokens) == source
        before = b""
        for _, row in tokens:
            assert row.line == before.count(b"\n") + 1
            assert row.column == len(before) - (before.rfind(b"\n") + 1) + 1
            before += row.token.encode()


def test_large_files_stay_linear(corpus):
    """Long literals, deep brackets and many functions in one file."""
    many = "".join(f"void f{i}(char *a) {{\n\tfree(a);\n}}\n" for i in range(4000))
    escapes = 'char *s = "' + "\\x41" * 40000 + '";\n'
    deep = "int d = " + "(" * 3000 + "1" + ")" * 3000 + ";\n"
    rows = sinks.sink_candidates(corpus({"big.c": escapes + deep + many})).select(
        "line", F.length("snippet").alias("n"), "function_line"
    )
    found = sorted(map(tuple, rows.collect()))
    assert len(found) == 4000
    assert found[0][0] == 4 and found[-1][0] == 3 * 4000 + 1
    assert all(line == start + 1 and n > 20 for line, n, start in found)
