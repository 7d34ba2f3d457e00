"""What a query job may touch (Q1, Q5): a check of the plan that Spark makes of its text.

The parsed plan lists every function a text calls, before anything is resolved or
evaluated; the analysed plan lists every relation and operator it resolves to. Both are held against
lists of what is allowed, so whatever is on no list is refused:

* relations: the session's own temp views (``allowed_session`` registers one per allowed table),
  the text's own common table expressions, and rows written in the text;
* functions: Spark's built-in ones, less those in ``REFUSED_FUNCTIONS``;
* operators: those of ``OPERATORS`` (no scripts, commands, or sources).

Nothing below a temp view is looked at: what it reads is the owner's choice.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Built-in functions that call into the JVM, show files and users of the engine, or read beyond the views.
REFUSED_FUNCTIONS = frozenset({
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "session_user", "user", "version", "current_catalog", "current_database", "current_schema"})

TABLE_FUNCTIONS = frozenset({"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer",
                             "json_tuple", "stack", "variant_explode", "variant_explode_outer"})

#: Logical operators of a query. ``View`` is checked by its name, the rest of the leaves hold rows of the text itself.
OPERATORS = frozenset({
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "AsOfJoin", "Window", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset",
    "Union", "Intersect", "Except", "Distinct", "Deduplicate", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef",
    "UnionLoop", "UnionLoopRef", "PipeOperator", "Generate", "Expand", "Sample", "Repartition", "RepartitionByExpression", "RebalancePartitions",
    "ResolvedHint", "OneRowRelation", "LocalRelation", "Range", "View"})


def _items(seq: JavaObject) -> Iterator:
    it = seq.iterator()  # an iterator gives itself
    while it.hasNext():
        yield it.next()


class Guard:
    """Checks the texts of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        sc = spark.sparkContext
        if getattr(sc, "_cairn_builtin", None) is None:
            sc._cairn_builtin = frozenset(r[0] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
        self.builtin = sc._cairn_builtin
        load = spark._jvm.java.lang.Class.forName
        loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        self.tree, self.command, self.seq, self.type, self.some = (
            load(n, True, loader) for n in ("org.apache.spark.sql.catalyst.trees.TreeNode", "org.apache.spark.sql.catalyst.plans.logical.Command",
                                            "scala.collection.Iterable", "org.apache.spark.sql.types.DataType", "scala.Some"))

    def run(self, text: str, args: Mapping | list | None = None) -> DataFrame:
        """The query's DataFrame, or PermissionError with what was refused."""
        self.check_parsed(text)
        df = self.spark.sql(text, args=args) if args else self.spark.sql(text)
        self.check_analysed(df)
        return df

    def check_parsed(self, text: str) -> None:
        parser = self.spark._jsparkSession.sessionState().sqlParser()
        try:
            # Only a query can stand in the FROM clause of another (or what reads there as a table and its alias).
            parser.parsePlan(f"SELECT * FROM (\n{text}\n)")
            plan = parser.parsePlan(text)
        except Exception as exc:
            raise PermissionError(f"not a query: {exc}") from exc
        for kind, node in self._parsed(plan):
            if self.command.isInstance(node):
                raise PermissionError(f"not a query: {kind}")
            if kind == "UnresolvedFunction":
                self._function([str(x) for x in _items(node.nameParts())], self.builtin - REFUSED_FUNCTIONS)
            elif kind == "UnresolvedTableValuedFunction":
                self._function([str(x) for x in _items(node.name())], TABLE_FUNCTIONS)
            elif kind == "UnresolvedRelation":
                parts = [str(x) for x in _items(node.multipartIdentifier())]
                if len(parts) > 1:
                    raise PermissionError(f"relation {'.'.join(parts)} is not allowed")
            elif "UnresolvedIdentifier" in kind:
                raise PermissionError("names made by an expression are not allowed")

    def _parsed(self, root: JavaObject) -> Iterator[tuple[str, JavaObject]]:
        """Every node and expression of a parsed plan, those of subqueries and common table expressions too."""
        left = [root]
        while left:
            x = left.pop()
            if not isinstance(x, JavaObject) or self.type.isInstance(x):
                continue
            name = x.getClass().getName()
            if self.tree.isInstance(x):
                yield name.rsplit(".", 1)[-1], x
                left += _items(x.productIterator())
            elif self.seq.isInstance(x):
                left += _items(x)
            elif self.some.isInstance(x):
                left.append(x.get())
            elif name.startswith("scala.Tuple"):
                left += _items(x.productIterator())

    @staticmethod
    def _function(parts: list[str], allowed) -> None:
        if len(parts) != 1 or parts[0].lower() not in allowed:
            raise PermissionError(f"function {'.'.join(parts).lower()} is not allowed")

    def check_analysed(self, df: DataFrame) -> None:
        left = [df._jdf.queryExecution().analyzed()]
        while left:
            node = left.pop()
            name = node.getClass().getName().rsplit(".", 1)[-1].rstrip("$")
            if name not in OPERATORS:
                raise PermissionError(f"{name} is not allowed in a query")
            if name == "View":
                identifier = node.desc().identifier()
                if not node.isTempView() or identifier.database().isDefined():
                    raise PermissionError(f"relation {identifier.unquotedString()} is not allowed")
                continue
            left += _items(node.children())
            left += _items(node.subqueries())

