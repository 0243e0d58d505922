"""RANGE frames of fixed bounds over a whole number, dealt out by stretches of the key.

Spark takes all rows of a window's partition in one task; without PARTITION BY that is the whole table, and with few values a share of it. A frame
of fixed bounds sees no further than its reach, so the keys are cut into stretches of a power of two, at least eight times the reach. A row goes to the
stretch of its key, and near a border to the next one too; windows are partitioned by stretch as well, and each row's value is that of its own
stretch, which holds the whole frame. A stretch has a bounded number of keys. Rows of one key stay together, as do those without a key, which are each
other's frame. Other windows are left as they are. A copy's own frame may be cut; its value is dropped, but a sum so near the end of its type that only a part
of the frame passes it would raise there.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.java_gateway import JavaClass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = {"tinyint", "smallint", "int", "bigint"}

# Keys of a stretch: 2 ** _BITS at least.
_BITS = 10


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _reach(window) -> int | None:
    """How far from a row's key the frames of a Window node reach; None if any of them is of another kind."""
    order = _list(window.orderSpec())
    if len(order) != 1 or order[0].child().dataType().catalogString() not in _WHOLE or not order[0].child().deterministic():
        return None
    reach = 0
    for named in _list(window.windowExpressions()):
        frame = named.child().windowSpec().frameSpecification()
        if frame.frameType().toString() != "RangeFrame":
            return None
        for bound in (frame.lower(), frame.upper()):
            if bound.getClass().getSimpleName() == "CurrentRow$":
                continue
            far = bound.eval(None) if bound.foldable() else None
            if far is None:
                return None
            reach = max(reach, abs(far))
    return reach if reach < 1 << 56 else None


class _Spreading:
    def __init__(self, df: DataFrame):
        self.spark, self.client = df.sparkSession, df.sparkSession.sparkContext._gateway._gateway_client
        self.mark = self.java("org.apache.spark.sql.catalyst.trees.TreePattern").WINDOW()

    def java(self, name: str) -> JavaClass:
        """A class by its whole name; through the gateway's packages each part of the name would be asked for."""
        return JavaClass(name, self.client)

    def frame(self, plan) -> DataFrame:
        return DataFrame(self.java("org.apache.spark.sql.classic.Dataset").ofRows(self.spark._jsparkSession, plan), self.spark)

    def column(self, expression) -> Column:
        return Column(self.java("org.apache.spark.sql.classic.ExpressionUtils").column(expression))

    def seq(self, items: list):
        return self.spark._jvm.PythonUtils.toSeq(items)

    def above(self, child, step: Callable[[DataFrame], DataFrame]):
        """What `step` puts on a plan, resolved over an empty table of its columns: the plan may refer to a WITH further up."""
        empty = self.java("org.apache.spark.sql.catalyst.plans.logical.LocalRelation")(child.output(), self.seq([]), False, self.java("scala.Option").empty())

        def graft(node):
            below = _list(node.children())
            return node.withNewChildren(self.seq([graft(c) for c in below])) if below else child

        return graft(step(self.frame(empty))._jdf.queryExecution().analyzed())

    def plan(self, node):
        """The plan with its windows spread; the same object where there is nothing to do."""
        if not node.containsPattern(self.mark):
            return node
        if node.nodeName() == "Window" and (reach := _reach(node)) is not None:
            return self.spread(node, reach)
        old = _list(node.children())
        new = [self.plan(c) for c in old]
        return node if all(a is b for a, b in zip(old, new, strict=True)) else node.withNewChildren(self.seq(new))

    def spread(self, top, reach: int):
        """A window, and those below it over the same key that it does not read, in one dealing."""
        chain, key = [top], top.orderSpec().head().child()
        while (below := chain[-1].child()).nodeName() == "Window" and (more := _reach(below)) is not None and below.orderSpec().head().child().semanticEquals(key):
            if any(w.references().contains(named.toAttribute()) for w in chain for named in _list(below.windowExpressions())):
                break
            chain.append(below)
            reach = max(reach, more)
        bits = max(_BITS, reach.bit_length() + 3)
        value = self.column(key).cast("long")
        home, place = F.shiftright(value, bits), value.bitwiseAND(F.lit((1 << bits) - 1))
        stretches = F.sequence(home - (place < reach).cast("long"), home + (place >= (1 << bits) - reach).cast("long"))  # null for no key
        plan = self.above(self.plan(chain[-1].child()), lambda df: df.select("*", F.explode_outer(stretches).alias("_stretch")))
        stretch = plan.output().last()
        for w in reversed(chain):
            plan = w.copy(w.windowExpressions(), w.partitionSpec().appended(stretch), w.orderSpec(), plan, w.hint())
        own = self.above(plan, lambda df: df.where(self.column(stretch).eqNullSafe(home)))
        return self.java("org.apache.spark.sql.catalyst.plans.logical.Project")(top.output(), own)


def spread(df: DataFrame) -> DataFrame:
    """The same rows and columns; windows of the kind above run in many tasks."""
    spreading, plan = _Spreading(df), df._jdf.queryExecution().analyzed()
    new = spreading.plan(plan)
    return df if new is plan else spreading.frame(new)
