"""Code reading by tokens: strings, comments, heads over lines, arguments, types; a syntax tree as brute force."""

import ast
import re

import pytest
from pyspark.sql import functions as F
from samples import files_of

from sourceweave.functions import lexer as L
from sourceweave.operators import graphs as gr
from sourceweave.operators import symbols as sy
from sourceweave.sources.corpus import _FASTAPI, _TRAP_PY, corpus

PY = '''"""Module text
class of things
def nothing(x):
import nowhere
"""
import os, sys
from a.b import (  # names
    c,
    d as e,
)
import re as patterns


@app.get(
    "/x(y",
    tags=["a, b", 'c'],
)
@plain
class Shelf(Base[K, V], Mixin, metaclass=Meta):
    # class Hidden: pass
    """Holds ( things."""

    marks = "a { b"  # def z(

    def f(self, a="x,)y", b: Dict[str, int] = {}, *rest) -> List[int]:
        # a comment first
        """F: does it."""
        text = """
def inner(q):
    return lost(q)
"""
        return g(a, h("p(q", [1, 2])(3), k=lambda t: (t, u(t)), **kw(a))

    async def last(self,
                   more):
        return await self.run(
            more,
            [pick(x, y) for x in range(len(more))],
            {"k": (1, 2)},
        )


def tail(): return f()
raw = r"\\("
'''
TS = """export class Store<T extends Row> extends Base<T, string> implements Keeps<Map<T, number>>, Sized {
  private rows: T[];
  get(id: string,
      mark = "}"): Promise<Map<string, number>> {
    const open = "{ no block"; // }
    /* } } */
    return this.load(id, `x${y}`, /[{(]/g, a / b / c);
  }
  load(a: Map<string, number>, b = { c: 1 }) {
    return check(a, (x) => x > 1);
  }
}
"""
JAVA = """@Service
@Named("a, b")
public class Yard extends Base<K, V> implements X, Y<Z> {
    private final Map<String, Integer> counts = new HashMap<>();
    int a, b = 2;
    @Inject Repo repo;
    static final String TEXT = \"\"\"
        class Hidden {
        \"\"\";

    public List<T> multi(
        Map<String, Integer> m,
        int n
    ) throws E {
        String s = "}"; char c = '{';
        return call("a, b", pick(n));
    }

    void after() { multi(null, 1); }
}
"""
GO = """type Server struct {
	Name, Alias string `json:"n"`
	Sizes map[string]int // {
	*Base
	store.Conn
}

type Reader interface {
	Read(p []byte) int
}

func (s *Server) Do(
	a int,
	b map[string]int,
) error {
	x := "{" + `raw {`
	return run(a, func() int { return one(1) })
}
"""


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_masking_keeps_every_place(spark):
    files = files_of(spark, a_py=PY, b_ts=TS, c_java=JAVA, d_go=GO)
    for r in sy.scoped_files(files).collect():
        assert len(r["masked"]) == len(r["content"]) and len(r["code"]) == r["content"].count("\n") + 1
        assert [c["text"] for c in r["code"]] == r["masked"].split("\n")
        assert all(m in (o, " ", L.FILL) for o, m in zip(r["content"], r["masked"], strict=True))


def test_strings_and_comments_are_no_code(spark):
    files = files_of(spark, a_py=PY, b_ts=TS, c_java=JAVA, d_go=GO)
    spans = set(rows(sy.block_spans(files), "path", "kind", "name", "start_line", "end_line"))
    first = {n.name: n for n in ast.walk(ast.parse(PY)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    want = {("a.py", "class" if isinstance(n, ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno) for n in first.values()}
    assert {s for s in spans if s[0] == "a.py"} == want
    assert {s for s in spans if s[0] == "b.ts"} == {("b.ts", "class", "Store", 1, 12), ("b.ts", "method", "get", 3, 8), ("b.ts", "method", "load", 9, 11)}
    assert {s for s in spans if s[0] == "c.java"} == {("c.java", "class", "Yard", 3, 20), ("c.java", "method", "multi", 11, 17), ("c.java", "method", "after", 19, 19)}
    assert {s for s in spans if s[0] == "d.go"} == {("d.go", "class", "Server", 1, 6), ("d.go", "class", "Reader", 8, 10), ("d.go", "method", "Do", 12, 18)}


def test_heads_over_lines(spark):
    functions = sy.extract_functions(files_of(spark, b_ts=TS, c_java=JAVA, d_go=GO))
    got = {n: (params.split(), kind) for n, params, kind in rows(functions, "name", "params", "return_type")}
    assert got["get"] == (["id:", "string,", "mark", "=", '"}"'], "Promise<Map<string, number>>")
    assert got["multi"] == (["Map<String,", "Integer>", "m,", "int", "n"], "List<T>") and got["Do"][1] == "error"
    parameters = rows(sy.extract_parameters(functions).orderBy("path", "start_line", "ordinal"), "function", "name", "type", "default_value")
    assert [p[1:] for p in parameters if p[0] == "multi"] == [("m", "Map<String, Integer>", ""), ("n", "int", "")]
    assert [p[1:] for p in parameters if p[0] == "get"] == [("id", "string", ""), ("mark", "", '"}"')]
    assert [p[1:] for p in parameters if p[0] == "Do"] == [("a", "int", ""), ("b", "map[string]int", "")]


def test_python_functions_docstrings_and_decorators(spark):
    files = files_of(spark, a_py=PY)
    got = {r["name"]: r for r in sy.extract_functions(files).collect()}
    tree = {n.name: n for n in ast.walk(ast.parse(PY)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    assert set(got) == set(tree)
    for name, node in tree.items():
        assert got[name]["docstring"] == (ast.get_docstring(node) or "") and got[name]["is_async"] == isinstance(node, ast.AsyncFunctionDef)
    assert rows(sy.extract_parameters(sy.extract_functions(files)).where("function = 'f'").orderBy("ordinal"), "name", "default_value")[1] == ("a", '"x,)y"')
    (c,) = sy.extract_classes(files).collect()
    assert (c["base_classes"], c["docstring"], len(c["decorators"])) == ("Base[K, V],Mixin", "Holds ( things.", 2)
    assert c["decorators"][0].startswith("app.get(\n") and c["decorators"][1] == "plain"
    assert rows(sy.extract_attributes(sy.extract_classes(files)), "name", "value") == [("marks", '"a { b"')]


def test_types_and_fields(spark):
    classes = sy.extract_classes(files_of(spark, b_ts=TS, c_java=JAVA, d_go=GO))
    got = {n: (b, d) for n, b, d in rows(classes, "name", "base_classes", "decorators")}
    assert got == {
        "Store": ("Base<T, string>,Keeps<Map<T, number>>,Sized", []), "Yard": ("Base<K, V>,X,Y<Z>", ["Service", 'Named("a, b")']),
        "Server": ("", []), "Reader": ("", []),
    }
    fields = rows(sy.extract_attributes(classes), "class_name", "name", "value")
    assert fields == [
        ("Store", "rows", "T[]"),
        ("Yard", "counts", "Map<String, Integer>"), ("Yard", "a", "int"), ("Yard", "b", "int"), ("Yard", "repo", "Repo"), ("Yard", "TEXT", "String"),
        ("Server", "Name", "string"), ("Server", "Alias", "string"), ("Server", "Sizes", "map[string]int"), ("Server", "Base", "*Base"), ("Server", "Conn", "store.Conn"),
    ]


def by_tree(source):
    """Calls of a Python file with plain callees, in the order of their places."""
    lines, found = source.split("\n"), []

    def text(node):
        return ast.get_source_segment(source, node)

    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.Call) and all(isinstance(x, (ast.Name, ast.Attribute, ast.Load)) for x in ast.walk(node.func)):
            args = sorted([*node.args, *node.keywords], key=lambda a: (a.lineno, a.col_offset))
            texts = [text(a) if not isinstance(a, ast.keyword) else (f"{a.arg}={text(a.value)}" if a.arg else f"**{text(a.value)}") for a in args]
            found.append((node.func.lineno, len(lines[node.func.lineno - 1].encode()[: node.func.col_offset]), text(node.func), texts))
    return [(line, callee, args) for line, _, callee, args in sorted(found, key=lambda f: f[:2])]


def filled(template):
    return re.sub("<<.*?>>", "5", template.lstrip("\n"))


@pytest.mark.parametrize("source", [PY, filled(_TRAP_PY), filled(_FASTAPI)])
def test_arguments_equal_a_syntax_tree(spark, source):
    got = rows(sy.extract_calls(files_of(spark, a_py=source)).orderBy("ordinal"), "line_no", "callee", "arguments")
    assert got == by_tree(source) and got


def test_arguments_of_other_languages(spark):
    calls = sy.extract_calls(files_of(spark, b_ts=TS, c_java=JAVA, d_go=GO)).orderBy("path", "ordinal")
    assert rows(calls, "callee", "arguments") == [
        ("this.load", ["id", "`x${y}`", "/[{(]/g", "a / b / c"]), ("check", ["a", "(x) => x > 1"]),
        ("Named", ['"a, b"']), ("call", ['"a, b"', "pick(n)"]), ("pick", ["n"]), ("multi", ["null", "1"]),
        ("run", ["a", "func() int { return one(1) }"]), ("one", ["1"]),
    ]


def test_imports_in_the_order_of_their_places(spark):
    js = "import './side';\nimport a, { b as c } from './both';\n"
    go = 'import (\n\t"fmt"\n\tx "a/b"\n)\nimport "os"\n'
    got = rows(sy.extract_imports(files_of(spark, a_py=PY, b_js=js, c_go=go)).orderBy("path", "ordinal"), "path", "module", "names")
    assert got == [
        ("a.py", "os", ["os", "sys"]), ("a.py", "a.b", ["c", "d as e"]), ("a.py", "re as patterns", ["re as patterns"]),
        ("b.js", "./side", []), ("b.js", "./both", ["a", "b as c"]), ("c.go", "fmt", []), ("c.go", "a/b", []), ("c.go", "os", []),
    ]


def test_variables_and_errors(spark):
    files = files_of(spark, a_py=PY, b_js="const a = f('(', 1); // x\nlet b = '[';\n", c_js="function f(a { return 1; }\n", d_py=None, e_py="")
    assert rows(sy.extract_variables(files).orderBy("path", "line_no"), "name", "value") == [("raw", r'r"\("'), ("a", "f('(', 1)"), ("b", "'['")]
    assert rows(sy.parse_errors(files), "path", "error") == [("c.js", "unbalanced brackets")]
    (s,) = sy.structure_summary(files).collect()
    assert (s["total_variables"], s["total_errors"], s["total_classes"]) == (3, 1, 1)


def test_long_tokens_need_no_deep_stack(spark):
    """Strings with many escapes, long lists and long comments are read without recursion."""
    text = 'a = "' + '\\"' * 60_000 + '"\nb = [' + "(1, 2),\n" * 30_000 + "]\n#" + " x" * 60_000 + "\ndef f():\n    return g(" + "h(1), " * 3_000 + ")\n"
    files = files_of(spark, a_py=text)
    assert rows(sy.extract_functions(files), "name", "start_line") == [("f", 30_004)]
    assert sy.extract_calls(files).where("callee = 'h'").count() == 3_000


def test_one_pass_over_the_corpus(spark, sf):
    plan = sy.structure_summary(corpus(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3  # one scan for each of the tables that the corpus is written from
    assert sy.file_facts(corpus(spark, sf)).select(F.size("spans")).where("false").count() == 0


def test_calls_without_their_arguments(spark):
    """Callers that ask for no argument texts get the same calls, and the pattern of arguments is not run."""
    files = files_of(spark, b_ts=TS, c_java=JAVA, d_go=GO)
    names = ["path", "ordinal", "line_no", "caller", "callee"]
    plain = sy.extract_calls(files, arguments=False)
    assert "arguments" not in plain.columns
    assert rows(plain.orderBy("path", "ordinal"), *names) == rows(sy.extract_calls(files).orderBy("path", "ordinal"), *names)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "(?=" not in plan


def test_many_imports_are_read_in_one_scan(spark):
    """What is looked up for each import is read once for the file, not once for the import."""
    files = files_of(spark, a_py="".join(f"from m{i} import a{i}, b{i}\n" for i in range(50)))
    got = rows(sy.extract_imports(files).orderBy("ordinal"), "module", "names")
    assert got == [(f"m{i}", [f"a{i}", f"b{i}"]) for i in range(50)]
    plan = sy.extract_imports(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip(regexp_extract_all(masked" in plan


def test_graph_summary_reads_the_texts_once(spark, sf):
    summary = gr.project_graph_summary(corpus(spark, sf))
    assert "parquet" not in summary._jdf.queryExecution().optimizedPlan().toString()
