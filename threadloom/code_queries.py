"""Queries over a table of Python code, made of part: every piece stands in a row 0 to 2 times.

Each line of the pieces says in a comment what it holds, `c` a node to count, `n` one to collect, `t`
both, `o` an operator. The analysis doesn't see comments, and the SQL sees nothing else, so the two are
independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import code
from threadloom.operators.pairs import parallelism
from threadloom.queries import query, table

_AUGMENTED = "".join(f"x {op}= 1  #o:{name}Assign;\n" for name, op in code.BINARY.values())
PIECES = [
    "import os, sys  #c:Import;n:Import;n:Import;o:Comma;\n"
    "from . import a1  #t:Import;o:Dot;\n"
    "from m import *  #t:Import;o:ImportStar;\n"
    "x = 1; y = 2  #o:Semicolon;n:VariableDeclaration;n:VariableDeclaration;\n"
    "z = x + y - 3  #o:Add;o:Subtract;n:VariableDeclaration;\n"
    "w = x * y / 2 // 3 % 5 ** 2 @ x  #o:Multiply;o:Divide;o:FloorDivide;o:Modulo;o:Power;o:MatrixMultiply;n:VariableDeclaration;\n"
    "v = x & y | z ^ 1 << 2 >> 1  #o:BitAnd;o:BitOr;o:BitXor;o:LeftShift;o:RightShift;n:VariableDeclaration;\n"
    "u = -x if not y else +z  #o:Minus;o:Not;o:Plus;n:VariableDeclaration;\n"
    "t = ~x  #o:BitInvert;n:VariableDeclaration;\n"
    "s: str = f'{x=}'  #o:AssignEqual;o:AssignEqual;\n",
    "ok = x == 1 and y != 2 or z > 3  #o:Equal;o:NotEqual;o:GreaterThan;o:And;o:Or;n:VariableDeclaration;\n"
    "no = x >= 1 or y < 2 or z <= 3  #o:GreaterThanEqual;o:LessThan;o:LessThanEqual;o:Or;o:Or;n:VariableDeclaration;\n"
    "q = x in y, x not in y, x is y, x is not y  #o:In;o:NotIn;o:Is;o:IsNot;o:Comma;o:Comma;o:Comma;n:VariableDeclaration;\n",
    "def f(a: int, b=1, *, c: str = 'k') -> int:  #c:ArgumentType;c:ArgumentType;o:Comma;o:Comma;o:Comma;o:AssignEqual;o:AssignEqual;\n"
    "    'Doc.'  #n:Docstring;\n"
    "    if a and b:  #t:IfStatement;o:And;\n"
    "        return f(b, c='x')  #t:Return;t:FunctionCall;o:Comma;o:AssignEqual;\n"
    "    elif a:  #t:IfStatement;\n"
    "        pass  #t:Pass;\n"
    "    for i in range(a):  #t:ForLoop;t:FunctionCall;\n"
    "        a += i  #o:AddAssign;\n"
    "        continue  #t:Continue;\n"
    "    while a:  #t:WhileLoop;\n"
    "        break  #t:Break;\n"
    "    try:  #t:TryExcept;n:TryStatement;\n"
    "        raise ValueError(b)  #t:Raise;t:FunctionCall;\n"
    "    except ValueError as e:  #n:ExceptClause;\n"
    "        assert e, b  #t:Assert;o:Comma;\n"
    "    with open(b) as h:  #t:WithStatement;n:With;t:FunctionCall;\n"
    "        global g1  #t:GlobalStatement;\n"
    "    return lambda p, r=2: p[1:r]  #t:Return;t:LambdaFunction;o:Comma;o:AssignEqual;o:Colon;o:Colon;\n",
    "class K(B1):\n"
    "    def m(self, v: int):  #c:ArgumentType;c:ArgumentType;c:ArgumentType;c:ArgumentType;o:Comma;\n"
    "        'Doc.'  #n:Docstring;\n"
    "        def n():\n"
    "            nonlocal v  #t:NonlocalStatement;\n"
    "            yield v  #t:Yield;\n"
    "        return n  #t:Return;\n",
    "async def k(s):  #c:ArgumentType;\n"
    "    async for i in s:  #t:ForLoop;\n"
    "        await i.j()  #c:Await;c:FunctionCall;o:Dot;\n"
    "    async with s as h:  #t:WithStatement;n:With;\n"
    "        pass  #t:Pass;\n"
    "c1 = [i for i in x]  #t:ListComprehension;n:VariableDeclaration;\n"
    "c2 = {i: i for i in x}  #t:DictComprehension;n:VariableDeclaration;\n"
    "c3 = {i for i in x}  #t:SetComprehension;n:VariableDeclaration;\n"
    "c4 = (i for i in x)  #t:GeneratorExpression;n:VariableDeclaration;\n",
    _AUGMENTED,
]
BROKEN = "def broken(:\n"

_SOURCE = "(select p_partkey, case when p_partkey % 50 = 0 then 'def broken(:' || chr(10) else {} end as code from part)".format(
    " || ".join(f"repeat('{p.replace(chr(39), chr(39) * 2)}', cast((p_partkey + {i}) // {3**i} % 3 as bigint))" for i, p in enumerate(PIECES))
)
_TAGS = f"(select p_partkey, tag[1] as kind, tag[3:-2] as name from (select p_partkey, unnest(regexp_extract_all(code, '[cnto]:[A-Za-z]+;')) as tag from {_SOURCE}))"


def source(spark, sf) -> DataFrame:
    """(p_partkey, code). Keys are some bytes each and come in few splits, so they are spread before the code is made."""
    key, rows = F.col("p_partkey"), table(spark, sf, "part").select("p_partkey")
    whole = F.concat(*[F.repeat(F.lit(p), (F.floor((key + i) / 3**i) % 3).cast("int")) for i, p in enumerate(PIECES)])
    return rows.repartition(parallelism(spark), "p_partkey").select("p_partkey", F.when(key % 50 == 0, BROKEN).otherwise(whole).alias("code"))


def _some(df: DataFrame, amounts) -> DataFrame:
    return df.select("p_partkey", F.explode(amounts).alias("name", "n")).filter("n > 0").select("p_partkey", "name", F.col("n").cast("long").alias("n"))


@query(f"select p_partkey, name, count(*) as n from {_TAGS} where kind in ('c', 't', 'o') and name not in ('Yield', 'ImportStar', 'Semicolon') group by all")
def code_counters(spark, sf):
    """(p_partkey, name, n) of the registered counters of nodes and operators."""
    counted = code.count_all(source(spark, sf), "code")
    ends = {c: c.split("|")[1].removesuffix("OperatorCounter").removesuffix("Counter") for c in counted.columns if "|" in c}
    return _some(counted, F.map_from_arrays(F.array(*[F.lit(n) for n in ends.values()]), F.array(*[F.col(f"`{c}`") for c in ends])))


@query(f"select p_partkey, name, count(*) as n from {_TAGS} where kind in ('c', 't') group by all")
def code_node_counts(spark, sf):
    """Every node counter."""
    return _some(source(spark, sf), code.analysed(F.col("code"), parts=["counts"])["counts"])


@query(f"select p_partkey, name, count(*) as n from {_TAGS} where kind = 'o' group by all")
def code_operator_counts(spark, sf):
    """Every operator counter."""
    return _some(source(spark, sf), code.analysed(F.col("code"), parts=["operators"])["operators"])


@query(f"select p_partkey, name, count(*) as n from {_TAGS} where kind in ('n', 't') group by all")
def code_collected_nodes(spark, sf):
    """Every node collector, by how many sources it has."""
    found = code.collect_nodes(source(spark, sf), "code", code.NODE_COLLECTORS)
    names = F.array(*[F.lit(n) for n in code.NODE_COLLECTORS])
    return _some(found, F.map_from_arrays(names, F.array(*[F.size(f"`code_node|{n}Collector`") for n in code.NODE_COLLECTORS])))


_GROUP = "case when name in ('BitInvert', 'Minus', 'Not', 'Plus') then 'Unary' when name in ('And', 'Or') then 'Boolean' when name like '%Assign' then 'AugmentedAssignment' when name in ('AssignEqual', 'Colon', 'Comma', 'Dot', 'ImportStar', 'Semicolon') then 'Miscellaneous' when name in ('Equal', 'GreaterThan', 'GreaterThanEqual', 'In', 'Is', 'LessThan', 'LessThanEqual', 'NotEqual', 'IsNot', 'NotIn') then 'Comparison' else 'Binary' end"


@query(f"with o as (select p_partkey, name from {_TAGS} where kind = 'o') select p_partkey, name, count(*) as n from (select * from o union all select p_partkey, {_GROUP} from o) group by all")
def code_collected_operators(spark, sf):
    """Every operator collector and group, by how many tokens it has."""
    every = [*code.OPERATORS, *code.OPERATOR_GROUPS]
    found = code.collect_operators(source(spark, sf), "code", every)
    return _some(found, F.map_from_arrays(F.array(*[F.lit(n) for n in every]), F.array(*[F.size(f"`code_operator|{n}OperatorCollector`") for n in every])))


@query(f"select p_partkey, trim(regexp_replace(line, '  #.*$', '')) as statement, count(*) as n from (select p_partkey, unnest(string_split(code, chr(10))) as line from {_SOURCE} where p_partkey % 50 <> 0) where regexp_matches(line, '#t:(Return|Raise|Assert|Break|Continue|Pass|GlobalStatement|NonlocalStatement);') group by all")
def code_statements(spark, sf):
    """The collected sources of the simple statements."""
    names = ["Return", "Raise", "Assert", "Break", "Continue", "Pass", "GlobalStatement", "NonlocalStatement"]
    found = code.collect_nodes(source(spark, sf), "code", names)
    each = found.select("p_partkey", F.explode(F.concat(*[F.col(f"`code_node|{n}Collector`") for n in names])).alias("statement"))
    return each.groupBy("p_partkey", "statement").agg(F.count("*").alias("n"))


def _count(pattern: str) -> str:
    return f"cast(len(regexp_extract_all(code, '{pattern}')) as bigint)"


@query(
    f"select p_partkey, p_partkey % 50 <> 0 and code <> '' as valid, nullif(case when p_partkey % 50 <> 0 then regexp_extract(code, '(?m)^(?:async )?(?:def|class) ([A-Za-z0-9]+)', 1) end, '') as main, "
    f"{_count('def [a-z]+[(][^:]')} as functions, {_count('class [A-Z]')} as classes, {_count('[a-zA-Z][(](?:b, c=|a[)]:  #t|b[)])|[.]j[(]')} as calls, {_count('x [*&] ')} as products, {_count('Doc.')} > 0 as documented, p_partkey % 50 <> 0 as same from {_SOURCE}"
)
def code_definitions(spark, sf):
    """Validity, the main entity, numbers of definitions, calls and products, and equality without comments."""
    c, bare = F.col("code"), F.regexp_replace("code", r"  #[^\n]*", "")
    found = source(spark, sf).withColumn("e", code.entities(c)).withColumn("p", code.multiplications(c))
    number = lambda kind: F.size(F.filter("e", lambda x: x["kind"] == kind)).cast("long")
    documented = F.exists(F.filter("e", lambda x: x["kind"] == "function"), lambda x: x["code"].contains("'Doc.'"))
    return found.select(
        "p_partkey", code.is_valid_python(c).alias("valid"), code.main_entity(c).alias("main"), number("function").alias("functions"), number("class").alias("classes"), F.size(code.calls(c)).cast("long").alias("calls"),
        F.coalesce(F.col("p.count"), F.lit(0)).cast("long").alias("products"), documented.alias("documented"), F.coalesce(code.same_structure(c, bare), F.lit(False)).alias("same"),
    )


@query(f"select p_partkey, {_count('class K[(]B1[)]')} as subclasses, {_count('    def m[(]self, v: int[)]:')} as methods, {_count('def f[(]a: int')} as annotated, cast(0 as bigint) as nested, cast(0 as bigint) as left_docs from {_SOURCE}")
def code_signatures(spark, sf):
    """Classes by base and ancestor, signatures by qualified name, and docstrings left after their removal."""
    c = F.col("code")
    sig = code.signatures(c)
    # of classes alike in name, one stands for all in the ancestors
    base = F.size(F.filter(code.bases(c), lambda b: F.array_contains(b["bases"], "B1")))
    one = lambda name, params: F.size(F.filter(sig, lambda x: (x["name"] == name) & (x["params"] == params))).cast("long")
    left = F.regexp_count(F.coalesce(code.without_docstrings(c), F.lit("")), F.lit("Doc[.]")).cast("long")
    return source(spark, sf).select("p_partkey", base.cast("long").alias("subclasses"), one("K.m", "self, v: int").alias("methods"), one("f", "a: int, b=1, *, c: str='k'").alias("annotated"), one("n", "").alias("nested"), left.alias("left_docs"))


@query(f"select p_partkey, p_partkey % 50 <> 0 as parsed, case when p_partkey % 50 <> 0 then {_count('(?m)^ *(?:async )?def ')} else 0 end as hollow from {_SOURCE}")
def code_skeletons(spark, sf):
    """Sources with hollow functions, by the functions that are left in them (those inside functions go)."""
    made = code.skeleton(F.col("code"))
    kept = F.regexp_count(made, F.lit(r"(?m)^ *(?:async )?def ")) + F.regexp_count("code", F.lit("        def n"))
    return source(spark, sf).select("p_partkey", made.isNotNull().alias("parsed"), F.coalesce(kept, F.lit(0)).cast("long").alias("hollow"))
