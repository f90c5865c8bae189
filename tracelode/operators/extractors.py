"""Extractors that plug into one pass over the traces.

An extractor works in two phases. In the first it may aggregate over all slices (``gather``, a row for each target, finalised
before the second begins); in the second it maps each trace to its features. What it looks at in a trace is its
subjects: values such as the target's result or what an argument stands for. For each of them it says which rows count (``relevant``, and ``needs``, which looks at the subject), what
the rows before show (``running``), and what is found at a row: ``any`` (true if it is at any row), ``last`` (the value at the last row that has
one) and ``sum``. ``output`` makes columns of these.

``run`` fuses all extractors that it is given: the instructions are shuffled once, by trace; each row goes on once for each subject
for which it counts; one grouping by trace and subject finds everything; the rest happens within the partition. A row costs only the
conditions of the extractor whose subject it belongs to, since those of the others stand behind a CASE.

Defined cases: traces without target have no row. An extractor that doesn't apply to its target, or has no subject there (an
argument that the call doesn't have), gives null. Conditions that are null count as false. Of several targets in a trace the last counts. Columns of the
caller besides those of the long table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as v
from ..sources.relations import KEY, SLICE
from . import features, graph

#: What a long table of instructions has, apart from its key.
ROW = ["idx", "is_target", "op", "func", "args", "pred", "op0", "op1", "cond", "br", "beg_loop", "end_loop", "mem", "val", "res"]


def subject(value: Column, part: int = 0, at: Column | int = 0, start: Column | None = None) -> Column:
    """A value to look at. Subjects of different parts have outputs of their own; those of one part come in order of ``at``. start: the row after which it counts, the target's place by default."""
    column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(F.lit(part).alias("part"), column(at).cast("int").alias("at"), value.alias("value"), (F.col("t") if start is None else start).cast("int").alias("start"))


class Seen(NamedTuple):
    """A running aggregate that extractors share: rows of different extractors never meet in one window, so one aggregate of each kind serves all."""

    kind: str  # of KINDS
    value: Column


#: The set of texts, and the latest comparison.
KINDS = {"set": F.collect_set, "compared": lambda x: F.last(x, ignorenulls=True)}


class Extractor:
    """The protocol, with defaults. Conditions may use a row's columns, t, r, targs and last_idx of its trace, ``value`` and ``start`` of the subject, and the names given by gather, on_trace and running."""

    name: str
    #: Outputs of this many parts; of more than one, the output is an array of structs, in order.
    parts = 1

    def applies(self, returns: Column, n_args: Column) -> Column:
        """Whether a target of such a type has these features."""
        return F.lit(True)

    def gather(self, instrs: DataFrame) -> DataFrame | None:
        """First phase: target and columns of whatever is known once all slices were seen."""
        return None

    def on_trace(self) -> dict[str, Column]:
        """Columns over a trace as a whole, before subjects are taken."""
        return {}

    def subjects(self) -> Column:
        """Array of subjects."""
        return F.array(subject(F.col("r")))

    def relevant(self) -> Column:
        """Rows that can matter. The target's row is always among those that conditions see, so that each subject has one."""
        return F.col("idx") > F.col("t")

    def needs(self, value: Column, at: Column, start: Column) -> Column:
        """Of the relevant rows those that can matter to such a subject; the target's row always stays."""
        return F.lit(True)

    def running(self) -> dict[str, Column | Seen]:
        """Aggregates over the rows of a subject before the present one."""
        return {}

    def any(self) -> dict[str, Column]:
        return {}

    def last(self) -> dict[str, Column]:
        return {}

    def sum(self) -> dict[str, Column]:
        return {}

    def output(self, found: dict[str, Column]) -> dict[str, Column]:
        """Named columns from those of any, last and sum."""
        return found

    def finish(self, rows: DataFrame) -> DataFrame:
        """What takes several traces together, over the final rows."""
        return rows


def _op(*names: str) -> Column:
    return F.col("op").isin(*names)


def _uses(value: Column) -> Column:
    return (F.col("op0") == value) | (F.col("op1") == value)


def _touches(value: Column) -> Column:
    """Of the rows that only count if they use the value those that do, and all others."""
    return ~_op("Bin", "ICmp", "Call") | (_op("Bin", "ICmp") & features.no(_uses(value))) | (_op("Call") & features.no(F.array_contains("args", value)))


class ControlFlow(Extractor):
    name = "control_flow"

    def relevant(self) -> Column:
        return F.col("beg_loop") | F.col("end_loop") | _op("CondBr")

    def any(self) -> dict[str, Column]:
        return {"has_loop": F.col("beg_loop"), "has_cond_br_after_target": _op("CondBr") & (F.col("idx") > F.col("t"))}

    def sum(self) -> dict[str, Column]:
        depth = F.when(F.col("beg_loop"), 1).otherwise(0) - F.when(F.col("end_loop"), 1).otherwise(0)
        return {"depth": F.when(F.col("idx") < F.col("t"), depth)}

    def output(self, found: dict[str, Column]) -> dict[str, Column]:
        return {"has_loop": found["has_loop"], "target_in_a_loop": found["depth"] > 0, "has_cond_br_after_target": found["has_cond_br_after_target"]}


class Result(Extractor):
    """What happens to the target's result."""

    name = "ret"

    def applies(self, returns: Column, n_args: Column) -> Column:
        return returns != "void"

    def relevant(self) -> Column:
        return (F.col("idx") > F.col("t")) & _op("Call", "Bin", "ICmp", "Load", "Store", "GEP", "Ret")

    def needs(self, value: Column, at: Column, start: Column) -> Column:
        return _touches(value)

    @staticmethod
    def _stored() -> Column:
        return _op("Store") & (F.col("val") == F.col("value")) & (F.col("mem") != F.col("value"))

    def running(self) -> dict[str, Column | Seen]:
        mem = F.col("mem")
        place = F.when(mem.rlike(v.PLACES), mem).when(mem.startswith('{"GEP":'), v.base_of(mem))
        return {"children": Seen("set", F.when(_op("GEP") & (mem == F.col("value")), F.col("res"))), "places": Seen("set", F.when(self._stored(), place))}

    def any(self) -> dict[str, Column]:
        r, mem, out = F.col("value"), F.col("mem"), F.col("op0")
        child, ends = F.array_contains("ret_children", mem), _op("Ret") & (F.col("idx") == F.col("last_idx"))
        return {
            "used_in_call": _op("Call") & (F.col("idx") > F.col("t")) & F.array_contains("args", r), "used_in_bin": _op("Bin") & _uses(r), "in_icmp": _op("ICmp") & _uses(r), "stored": self._stored(),
            "derefed": (_op("Load") & ((mem == r) | child)) | (_op("Store") & ((mem == r) | (child & (F.col("val") != r)))) | (_op("GEP") & (mem == r)),
            "returned": ends & (out == r), "indir_returned": ends & (out != r) & F.array_contains("ret_places", out),
        }

    def output(self, found: dict[str, Column]) -> dict[str, Column]:
        used = found["used_in_call"] | found["used_in_bin"] | found["in_icmp"]
        return {"used": used} | {n: c for n, c in found.items() if n != "in_icmp"}


class _Checked(Extractor):
    """How a value is compared after its start, and which way the branches on it go."""

    def _hit(self) -> Column:
        return _op("ICmp") & (F.col("idx") > F.col("start")) & _uses(F.col("value"))

    def running(self) -> dict[str, Column | Seen]:
        number = F.coalesce(v.number_of(F.col("op0")), v.number_of(F.col("op1")))
        return {"cmp": Seen("compared", F.when(features.no(self._hit()), F.struct(F.col("res").alias("res"), F.col("pred").alias("pred"), number.alias("number"))))}

    def _branch(self) -> Column:
        return _op("CondBr") & (F.col("cond") == F.col(f"{self.name}_cmp.res"))

    def any(self) -> dict[str, Column]:
        number = F.col(f"{self.name}_cmp.number")
        return {"checked": self._hit(), "compared_with_zero": self._branch() & (number == 0), "compared_with_non_const": self._branch() & number.isNull()}

    def last(self) -> dict[str, Column]:
        pred = F.col(f"{self.name}_cmp.pred")
        decided = self._branch() & (F.col(f"{self.name}_cmp.number") == 0) & pred.isin("EQ", "NE")
        return {"is_zero": F.when(decided, (pred == "EQ") == (F.col("br") == "Then"))}


class ResultCheck(_Checked):
    name = "ret_check"

    def applies(self, returns: Column, n_args: Column) -> Column:
        return returns != "void"

    def relevant(self) -> Column:
        return (F.col("idx") > F.col("t")) & _op("ICmp", "CondBr")

    def needs(self, value: Column, at: Column, start: Column) -> Column:
        return _touches(value)

    def output(self, found: dict[str, Column]) -> dict[str, Column]:
        return {"checked": found["checked"], "br_eq_zero": found["is_zero"], "br_neq_zero": ~found["is_zero"], "compared_with_zero": found["compared_with_zero"], "compared_with_non_const": found["compared_with_non_const"]}

    def finish(self, rows: DataFrame) -> DataFrame:
        """slice_checked: checked in any trace of the slice."""
        any_trace = features.no(F.bool_or(F.col("ret_check.checked")).over(Window.partitionBy(*SLICE)))
        return rows.withColumn("ret_check", F.when(F.col("ret_check").isNotNull(), F.col("ret_check").withField("slice_checked", any_trace)))


class ArgumentBefore(Extractor):
    """What argument i is, and how it is checked before the call."""

    def __init__(self, i: int, depth: int = 3, lookahead: int = 5) -> None:
        self.name, self.i, self.depth, self.lookahead = f"arg_{i}_pre", i, depth, lookahead

    def applies(self, returns: Column, n_args: Column) -> Column:
        return n_args > self.i

    def on_trace(self) -> dict[str, Column]:
        ahead = Window.partitionBy(*KEY).orderBy("idx").rowsBetween(1, self.lookahead)
        return {f"ways_{self.lookahead}": F.collect_list(F.when(_op("CondBr"), F.struct("cond", "br"))).over(ahead)}

    def subjects(self) -> Column:
        found = v.candidates(F.get("targs", F.lit(self.i)), self.depth)
        return F.transform(found, lambda x, at: subject(x, at=at))

    def relevant(self) -> Column:
        return (F.col("idx") < F.col("t")) & _op("ICmp")

    def needs(self, value: Column, at: Column, start: Column) -> Column:
        return _touches(value)

    def _open(self) -> Column:
        """Once a value is constant, it and those after it are not checked."""
        upto = F.slice(v.candidates(F.get("targs", F.lit(self.i)), self.depth), F.lit(1), F.col("_at") + 1)
        return ~F.exists(upto, lambda x: v.kind_of(x) == "Const")

    def any(self) -> dict[str, Column]:
        hit = (F.col("idx") < F.col("t")) & _op("ICmp") & _uses(F.col("value")) & self._open()
        zero = hit & v.is_zero(F.when(F.col("op0") == F.col("value"), F.col("op1")).otherwise(F.col("op0")))
        then = F.when(F.col("pred") == "EQ", "Then").when(F.col("pred") == "NE", "Else")
        other = F.when(then == "Then", "Else").when(then == "Else", "Then")
        way = lambda br: F.exists(f"ways_{self.lookahead}", lambda x: (x["cond"] == F.col("res")) & (x["br"] == br))
        kind = v.kind_of(F.col("value"))
        return {
            "checked": hit, "compared_with_zero": zero, "arg_check_is_zero": zero & way(then), "arg_check_not_zero": zero & way(other),
            "is_arg": kind == "Arg", "is_constant": kind == "Const", "is_global": kind == "Glob", "is_alloca": kind == "Alloc",
        }


class ArgumentAfter(Extractor):
    """What happens to argument i after the call, for each of the values it stands for in turn; what one finds is remembered for the next."""

    def __init__(self, i: int, depth: int = 5) -> None:
        self.name, self.i, self.depth = f"arg_{i}_post", i, depth

    def applies(self, returns: Column, n_args: Column) -> Column:
        return n_args > self.i

    def subjects(self) -> Column:
        return F.transform(v.candidates(F.get("targs", F.lit(self.i)), self.depth), lambda x, at: subject(x, at=at))

    def relevant(self) -> Column:
        return (F.col("idx") > F.col("t")) & _op("Call", "Bin", "ICmp", "Load", "Store", "GEP", "Ret")

    def needs(self, value: Column, at: Column, start: Column) -> Column:
        return _touches(value)

    def _kept(self) -> Column:
        return _op("Store") & (F.col("val") == F.col("value")) & ~features.no(F.col("mem") == F.col("value")) & (F.col("idx") > F.col("t"))

    def running(self) -> dict[str, Column | Seen]:
        mem = F.col("mem")
        place = F.when(mem.rlike(r'^\{"(Arg|Sym|Glob|Alloc)":'), mem).when(mem.startswith('{"GEP":'), F.get_json_object(mem, "$.GEP.loc"))
        return {
            "children": Seen("set", F.when((F.col("idx") > F.col("t")) & _op("GEP") & (mem == F.col("value")), F.col("res"))), "places": Seen("set", F.when(self._kept(), place)),
            "allocated": Seen("set", F.when(self._kept(), F.concat(F.lit('{"AllocOf":'), mem, F.lit("}")))),
        }

    def any(self) -> dict[str, Column]:
        arg, mem, out = F.col("value"), F.col("mem"), F.col("op0")
        after, child, ends = F.col("idx") > F.col("t"), F.array_contains(f"{self.name}_children", mem), _op("Ret") & (F.col("idx") == F.col("last_idx"))
        known = F.array_contains(f"{self.name}_places", out) | F.array_contains(f"{self.name}_allocated", out)
        return {
            "used_in_call": after & _op("Call") & F.array_contains("args", arg), "used_in_bin": after & _op("Bin") & _uses(arg), "used_in_check": after & _op("ICmp") & _uses(arg),
            "derefed": after & ((_op("Store", "Load") & (mem == arg)) | (child & (_op("Load") | (_op("Store") & (F.col("val") != arg))))),
            "returned": after & ends & (out == arg), "indir_returned": after & ends & (out != arg) & (known | out.contains(arg)),
        }

    def output(self, found: dict[str, Column]) -> dict[str, Column]:
        return {"used": found["used_in_call"] | found["used_in_check"] | found["used_in_bin"] | found["derefed"]} | found


class Causality(_Checked):
    """How calls of the target's heaviest functions before or after it relate to it; one struct for each of them, by rank."""

    def __init__(self, after: bool, size: int = 5, depth: int = 2, words: DataFrame | None = None) -> None:
        """words: target, func and rank, if they are known already."""
        self.name, self.after, self.parts, self.depth, self.words = "after" if after else "before", after, size, depth, words

    def gather(self, instrs: DataFrame) -> DataFrame:
        words = features.top_functions(features.dictionary(instrs), self.parts) if self.words is None else self.words
        return words.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "func"))), lambda x: x["func"]).alias(f"top_{self.parts}"))

    def _function(self, j: int) -> Column:
        return F.get(f"top_{self.parts}", F.lit(j))

    def _side(self) -> Column:
        return F.col("idx") > F.col("t") if self.after else F.col("idx") < F.col("t")

    def on_trace(self) -> dict[str, Column]:
        """Of several calls with a result the one farthest from the target decides how it is checked."""
        whole, out = Window.partitionBy(*KEY), {}
        for j in range(self.parts):
            call = self._side() & _op("Call") & F.col("res").isNotNull() & (F.col("func") == self._function(j))
            out[f"{self.name}_{j}"] = F.max_by(F.when(call, F.struct("idx", "res")), F.when(call, F.col("idx") if self.after else -F.col("idx"))).over(whole)
        return out

    def subjects(self) -> Column:
        """For each function a subject for its calls (at 0) and one for how the result of the deciding one is checked (at 1)."""
        found = []
        for j in range(self.parts):
            there, call = self._function(j).isNotNull(), F.col(f"{self.name}_{j}")
            found += [F.when(there, subject(self._function(j), j, 0)), F.when(call.isNotNull(), subject(call["res"], j, 1, call["idx"]))]
        return F.filter(F.array(*found), lambda s: s.isNotNull())

    def relevant(self) -> Column:
        return (self._side() & _op("Call")) | _op("ICmp", "CondBr")

    def needs(self, value: Column, at: Column, start: Column) -> Column:
        """Calls of the function, and what may compare the result of the deciding one or branch on it."""
        return F.when(at == 0, _op("Call") & (F.col("func") == value)).otherwise((F.col("idx") > start) & (_op("CondBr") | (_op("ICmp") & _uses(value))))

    def _call(self) -> Column:
        return (F.col("_at") == 0) & self._side() & _op("Call") & (F.col("func") == F.col("value"))

    def _hit(self) -> Column:
        return (F.col("_at") == 1) & super()._hit()

    def _branch(self) -> Column:
        return (F.col("_at") == 1) & (F.col("idx") > F.col("start")) & super()._branch()

    def any(self) -> dict[str, Column]:
        unwrap = lambda a: F.flatten(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: v.candidates(x, self.depth)))
        mine, theirs = unwrap(F.col("args")), unwrap(F.col("targs"))
        returns = F.array_contains(mine, F.col("r")) if self.after else F.array_contains(theirs, F.col("res"))
        return {"share_return": self._call() & returns, "share_argument": self._call() & F.arrays_overlap(mine, theirs), "checked": self._hit()}

    def sum(self) -> dict[str, Column]:
        return {"calls": F.when(self._call(), 1)}

    def output(self, found: dict[str, Column]) -> dict[str, Column]:
        return {
            "invoked": found["calls"] > 0, "invoked_more_than_once": found["calls"] > 1, "share_return": found["share_return"], "share_argument": found["share_argument"],
            "checked": found["checked"], "is_zero": found["is_zero"], "not_zero": ~found["is_zero"],
        }


def standard(dictionary_size: int = 5, arguments: int = 7, words: DataFrame | None = None) -> list[Extractor]:
    """All extractors of the engine."""
    pairs = [x for i in range(arguments) for x in (ArgumentBefore(i), ArgumentAfter(i))]
    return [Result(), ResultCheck(), *pairs, Causality(False, dictionary_size, words=words), Causality(True, dictionary_size, words=words), ControlFlow()]


def run(instrs: DataFrame, extractors: Sequence[Extractor], types: DataFrame | None = None) -> DataFrame:
    """The key of each trace and, for each extractor, a column of its name: a struct, or an array of structs where it has several parts.

    types: target, returns and n_args, a row for each target; without it every extractor applies to every target.
    """
    if len({e.name for e in extractors}) < len(extractors):
        raise ValueError("extractors need different names")
    rows = instrs.select(*KEY, *ROW)
    gathered: dict[str, DataFrame] = {}
    for e in extractors:
        state = e.gather(rows)
        if state is not None:
            gathered.setdefault(",".join(state.columns), state)
    for state in gathered.values():
        rows = rows.join(graph.written(state, "extractor-state"), "target", "left")
    if types is not None:
        known = types.select("target", F.array(*[F.when(e.applies(F.col("returns"), F.col("n_args")), F.lit(i)) for i, e in enumerate(extractors)]).alias("_applies"))
        rows = rows.join(known, "target", "left")
    rows = features.with_target(rows)
    on_trace: dict[str, Column] = {}
    for e in extractors:
        on_trace |= e.on_trace()
    rows = rows.withColumns(on_trace) if on_trace else rows

    def subjects(m: int, e: Extractor) -> Column:
        fits = (e.relevant() | F.col("is_target")) & (F.array_contains("_applies", m) if types is not None else F.lit(True))
        kept = F.filter(e.subjects(), lambda s: F.col("is_target") | features.no(e.needs(s["value"], s["at"], s["start"])))
        held = F.transform(kept, lambda s: F.struct(F.lit(m).alias("m"), s["part"].alias("part"), s["at"].alias("at"), s["value"].alias("value"), s["start"].alias("start")))
        return F.when(features.no(fits), F.coalesce(held, F.array().cast(kind))).otherwise(F.array().cast(kind))

    kind = "array<struct<m:int,part:int,at:int,value:string,start:int>>"
    anchor = F.when(F.col("idx") == F.col("t"), F.array(F.struct(F.lit(-1).alias("m"), F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("start")))).otherwise(F.array().cast(kind))
    rows = rows.withColumn("_s", F.explode(F.concat(anchor, *[subjects(m, e) for m, e in enumerate(extractors)])))
    rows = rows.select("*", F.col("_s.m").alias("_m"), F.col("_s.part").alias("_part"), F.col("_s.at").alias("_at"), F.col("_s.value").alias("value"), F.col("_s.start").alias("start")).drop("_s")
    before = Window.partitionBy(*KEY, "_m", "_part").orderBy("_at", "idx").rowsBetween(Window.unboundedPreceding, -1)
    shared: dict[tuple[str, int], Column] = {}
    known: dict[str, Column] = {}
    for m, e in enumerate(extractors):
        own: dict[str, int] = {}
        for n, x in e.running().items():
            if isinstance(x, Seen):
                slot = x.kind, own.setdefault(x.kind, 0)
                own[x.kind] += 1
                shared[slot] = shared[slot].when(F.col("_m") == m, x.value) if slot in shared else F.when(F.col("_m") == m, x.value)
                known[f"{e.name}_{n}"] = F.col(f"_{slot[0]}_{slot[1]}")
            else:
                known[f"{e.name}_{n}"] = F.when(F.col("_m") == m, x.over(before))
    if shared:
        rows = rows.withColumns({f"_{kind}_{i}": KINDS[kind](x).over(before) for (kind, i), x in shared.items()})
    if known:
        rows = rows.withColumns(known)

    def slots(of: str) -> list[Column]:
        """The conditions of all extractors by their place; a row meets those of its own extractor alone."""
        each = [list(getattr(e, of)().values()) for e in extractors]
        out = []
        for i in range(max(map(len, each), default=0)):
            case = None
            for m, own in enumerate(each):
                if i < len(own):
                    case = F.when(F.col("_m") == m, own[i]) if case is None else case.when(F.col("_m") == m, own[i])
            out.append(case)
        return out

    aggregates = [features.any_(x).alias(f"any_{i}") for i, x in enumerate(slots("any"))] + [F.sum(x).alias(f"sum_{i}") for i, x in enumerate(slots("sum"))]
    aggregates += [F.max_by(x, F.when(x.isNotNull(), F.col("idx"))).alias(f"last_{i}") for i, x in enumerate(slots("last"))]
    found = rows.groupBy(*KEY, "_m", "_part").agg(F.lit(1).alias("_one"), *aggregates)

    def outputs(e: Extractor) -> Column:
        cells = {n: F.col(f"{of}_{i}") for of in ("any", "sum", "last") for i, n in enumerate(getattr(e, of)())}
        cells |= {n: F.coalesce(c, F.lit(0)) for n, c in cells.items() if n in e.sum()}
        return F.struct(*[features.no(c).alias(n) if n not in e.sum() else c.alias(n) for n, c in e.output(cells).items()])

    def assembled(m: int, e: Extractor) -> Column:
        own = F.col("_m") == m
        if e.parts == 1:
            return F.max_by(F.when(own, outputs(e)), F.when(own, 1)).alias(e.name)
        return F.transform(F.sort_array(F.collect_list(F.when(own, F.struct(F.col("_part").alias("part"), outputs(e).alias("found"))))), lambda x: x["found"]).alias(e.name)

    out = found.groupBy(*KEY).agg(*[assembled(m, e) for m, e in enumerate(extractors)])
    for e in extractors:
        out = e.finish(out)
    return out
