import ast
import glob
import os

import pytest
from pyspark.sql import functions as F

from threadloom.functions import code, text
from threadloom.functions.code import analyse

SLICES = "from .. import x\nfrom a.b import *\nd = c[1:2]; e = c[::2]\nif a < b <= c and d not in e and f is not g: pass\nk = lambda q, r=1: q[0]\nh(z=1)\nv: int = 3\n"


def test_counters_on_a_snippet():
    a = analyse("class A:\n    def m(self, x):\n        return x\n    def n(self):\n        pass\ndef f(a, *b, c=1):\n    for i in a:\n        if i:\n            break\n        elif a:\n            continue\n")
    assert a["counts"]["ArgumentType"] == 2 * (2 + 1) + 1
    assert a["counts"]["IfStatement"] == 2
    assert a["counts"]["ForLoop"] == a["counts"]["Break"] == a["counts"]["Continue"] == a["counts"]["Pass"] == 1
    assert a["counts"]["BaseCompoundStatement"] == 0
    assert analyse("if a:\n    pass\n", strict=False)["counts"]["BaseCompoundStatement"] == 1


def test_operator_tokens():
    o = analyse(SLICES)["operators"]
    assert o["Semicolon"] == 1
    assert o["ImportStar"] == 1
    assert o["Dot"] == 2 + 1
    assert o["Colon"] == 1 + 2 + 1
    assert o["AssignEqual"] == 3
    assert o["And"] == 2
    assert (o["LessThan"], o["LessThanEqual"], o["NotIn"], o["IsNot"], o["Not"]) == (1, 1, 1, 1, 0)
    assert analyse("x = f'{y=}'\n")["operators"]["AssignEqual"] == 1
    assert analyse("x: t = ...\n")["operators"]["Dot"] == 0


def test_collectors():
    a = analyse("import os, sys\ndef f(a: int, b):\n    '''Doc.'''\n    x = g(a)\n    o.h()\n    x += 1\n    return -x\n")
    assert a["nodes"]["Import"] == ["import os, sys"] * 2
    assert a["nodes"]["FunctionCall"] == ["g"]
    assert a["nodes"]["Docstring"] == ["Doc."]
    assert a["nodes"]["VariableDeclaration"] == ["x = g(a)"]
    assert a["nodes"]["Return"] == ["return -x"]
    assert a["argument_types"] == [["int", None]]
    assert a["tokens"]["AddAssign"] == ["+="]
    assert a["tokens"]["Unary"] == ["Minus"]


def test_counts_add_up_over_joined_snippets():
    one, two = "a = b + c\n", "for i in x:\n    y(i, -1)\n"
    a, b, both = analyse(one), analyse(two), analyse(one + two)
    assert both["operators"] == {k: a["operators"][k] + b["operators"][k] for k in a["operators"]}


def test_columns_and_parse_errors(spark):
    df = spark.createDataFrame([(1, "a = b * c\n"), (2, "def (:\n"), (3, None), (4, "")], "id int, code string")
    got = {r.id: r for r in code.count_operators(code.count_node_types(df, "code"), "code").collect()}
    assert got[1]["code_operator_count|MultiplyOperatorCounter"] == 1
    assert got[2]["code_node_count|ReturnCounter"] is None
    assert got[2]["code_parse_error"]
    assert got[4]["code_node_count|ReturnCounter"] == 0
    assert len([c for c in code.count_node_types(df, "code").columns if "_node_count|" in c]) == 23
    assert len([c for c in code.count_operators(df, "code").columns if "_operator_count|" in c]) == 46
    with pytest.raises(Exception, match="invalid syntax"):
        code.count_operators(df, "code", fail=True).collect()
    assert {r.id: r["code_operator|MultiplyOperatorCollector"] for r in code.collect_operators(df, "code").collect()}[1] == ["*"]
    assert {r.id: r["code_node|VariableDeclarationCollector"] for r in code.collect_nodes(df, "code").collect()}[1] == ["a = b * c"]


def test_definitions_and_rewrites(spark):
    source = "class A(B, C):\n    '''D.'''\n    def f(self, x: int) -> int:\n        '''E.'''\n        return x * 2\nclass Z(A):\n    pass\ndef g(y):\n    return dot(y, y) & 1\n"
    df = spark.createDataFrame([(source, source.replace("'''D.'''", "'''D.'''  # note"))], "a string, b string")
    r = df.select(
        code.entities("a").alias("e"), code.docstring("a").alias("doc"), code.without_docstrings("a").alias("bare"), code.skeleton("a").alias("skeleton"), code.same_structure(F.col("a"), F.col("b")).alias("same"),
        code.is_valid_python("a").alias("valid"), code.main_entity("a").alias("main"), code.ancestors("a").alias("up"), code.multiplications("a").alias("mult"), code.signatures("a").alias("sig"), code.calls("a").alias("calls"), code.minified("a").alias("small"),
    ).first()
    assert [(x["kind"], x["name"]) for x in r.e] == [("class", "A"), ("function", "f"), ("class", "Z"), ("function", "g")]
    assert r.doc == "E."
    assert "D." not in r.bare and "return x * 2" in r.bare
    assert "return" not in r.skeleton and "E." in r.skeleton
    assert r.same and r.valid and r.main == "A"
    assert [(x["cls"], x["ancestors"]) for x in r.up] == [("A", ["B", "C"]), ("Z", ["A", "B", "C"])]
    assert (r.mult["count"], r.mult["by_function"]) == (3, {"f": ["x * 2"], "g": ["dot(y, y) & 1", "dot(y, y)"]})
    assert [(x["name"], x["returns"]) for x in r.sig] == [("A.f", "int"), ("g", None)]
    assert r.calls[0]["args"] == ["y", "y"]


def test_visitors_and_blocks(spark):
    class Length:
        def __init__(self, source):
            self.source = source

        def collect(self):
            return len(self.source)

    df = spark.createDataFrame([("x = 1\nhello there you\ny = 2\n",)], "code string")
    assert code.apply_visitor(df, "code", Length, "int").first()["code_None|Length"] == 28
    got = df.select(text.python_blocks(F.col("code")).alias("b")).first().b
    assert [(b["first_line"], b["kind"]) for b in got] == [(0, "python"), (1, "text"), (2, "python")]


def test_minified_code_means_the_same(spark):
    source = "import os\nimport sys\n\n\nclass A(object):\n    x: int = 1\n\n    def f(self, a: int, b: str = 'k') -> int:\n        '''Doc.'''\n        y: int = a  if a else 1\n        pass\n        return f'{ y!r:>10} {{}}' + b\n\n\ndef g():\n    pass\n"
    (r,) = spark.createDataFrame([(source,)], "a string").select(code.minified("a").alias("m")).collect()
    assert r.m == "import os,sys\nclass A:\n x: int=1\n def f(self,a,b='k'):\n  \"\"\"Doc.\"\"\"\n  y=a if a else 1\n  return f'{y!r:>10} {{}}'+b\ndef g():\n pass".replace("x: int", "x:int")
    for p in glob.glob(os.path.join(os.path.dirname(code.__file__), "*.py")):
        text = open(p).read()
        small = code._minified(text)
        assert len(small) < len(text)
        assert ast.dump(ast.parse(small)) == ast.dump(ast.parse(ast.unparse(ast.fix_missing_locations(code._Smaller().visit(ast.parse(text))))))


def test_related_code(spark):
    from threadloom.operators import relational

    rows = [(1, "def area(x):\n    return square(x) + half(x) + print(x)\n"), (2, "def square(x):\n    return x * x\n"), (3, "def halfway(x):\n    return x / 2\n"), (4, "def half(x):\n    return x\n"), (5, "x = ("), (6, None)]
    df = spark.createDataFrame(rows, "id long, code string")
    got = {r.id: r.code_with_related_prompt for r in relational.with_related_code(df, "id", "code").collect()}
    assert got[1] == rows[0][1] + "\n\n Related Code: " + rows[1][1] + "\n\n" + rows[2][1]
    assert {k: v for k, v in got.items() if k != 1} == dict(rows[1:])


def test_equal_texts_are_analysed_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def noted(text):
        with open(calls, "a") as f:
            f.write("x")
        return len(text)

    df = spark.createDataFrame([(None if i % 4 == 3 else "x" * (i % 4),) for i in range(4000)], "code string").coalesce(1)
    got = df.groupBy("code", code._guarded("noted", noted, "int")("code").alias("n")).count().collect()
    assert sorted((-1 if r.n is None else r.n, r["count"]) for r in got) == [(-1, 1000), (0, 1000), (1, 1000), (2, 1000)]
    assert os.path.getsize(calls) == 3


def test_held_results_are_bounded_and_told_apart(spark, monkeypatch):
    monkeypatch.setattr(code, "KEPT", 10)
    monkeypatch.setattr(code, "_kept", {})
    texts = ["a" * n for n in (1, 4, 6, 1, 30, 4)]
    assert code.results(("length",), len, texts) == [1, 4, 6, 1, 30, 4]
    assert sum(map(len, code._kept[("length",)][0])) <= 10
    assert code.results(("upper",), str.upper, texts) == [t.upper() for t in texts]
    row = spark.createDataFrame([("def f():\n    'D.'\n    return 1\n",)], "a string").select(code.skeleton("a"), code.without_docstrings("a"), code.normalised("a"), code.main_entity("a")).first()
    assert len(set(row)) == 4


def test_code_of_a_small_file_is_spread(spark):
    from threadloom import code_queries

    assert code_queries.source(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_nodes_are_visited_in_order_without_operators_and_contexts():
    tree = ast.parse(SLICES + "match x:\n    case [1, *r] | {'k': v} if not -v:\n        async def f[T](*, a=1, **k): await (yield)\n")

    def plain(n):
        yield n
        for c in ast.iter_child_nodes(n):
            yield from plain(c)

    kept = [n for n in plain(tree) if not isinstance(n, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop))]
    assert list(map(id, code.preorder(tree))) == list(map(id, kept))
