"""Symbolic execution of slices: from an IR table to rows of trace_instrs.

IR rows: bc, func, block, pos, op, dst, a (JSON array of operands), loc and, if there is one, block_no, the block's place in
its function; without it blocks are in order of the first number in their names, then of the names. Operands are JSON values: a number, null,
{"reg": name}, {"arg": i}, {"glob": name}, {"func": name}. Operations: alloca, load (place), store (place, value),
gep (place, indices...), bin (name, x, y), cast (x), icmp (pred, x, y), br (block) or br (cond, then, else),
switch (x, default, case blocks...), call (callee, arguments...), phi ([value, block]...), ret (x?), unreachable.

One slice is one group and one task's work: its functions are few, and paths, instructions and pending
work have the limits of ``Limits``. Each branch direction is taken at most once on a path, so loops
end. A path is dropped if its branch conditions exclude each other; what the check can't tell counts as possible.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "target string, bc string, slice_id long, trace_id long, idx int, is_target boolean, loc string, op string, func string, args array<string>, pred string, op0 string, op1 string, cond string, br string, beg_loop boolean, end_loop boolean, mem string, val string, res string"
DUMMY = ("dbg", "eh", "lifetime")


@dataclass(frozen=True)
class Limits:
    traces: int = 50
    explored: int = 1000
    instrs: int = 5000
    work: int = 50
    depth: int = 8
    seed: int | None = None  # of a random choice among pending states, else the latest


def text(v: Any) -> str:
    """The canonical JSON of a value."""
    return json.dumps(v, sort_keys=True, separators=(",", ":"))


@dataclass
class Frame:
    func: str
    block: str
    before: str | None = None
    pos: int = 0
    regs: dict = field(default_factory=dict)
    args: list = field(default_factory=list)
    dst: str | None = None
    row: int | None = None


@dataclass
class State:
    frames: list[Frame]
    memory: dict = field(default_factory=dict)
    rows: list[dict] = field(default_factory=list)
    conditions: list = field(default_factory=list)
    taken: set = field(default_factory=set)
    fresh: int = 0
    target: int | None = None
    blocks: list = field(default_factory=list)

    def new(self, kind: str, **more: Any) -> Any:
        self.fresh += 1
        return {kind: {"id": self.fresh - 1, **more}} if more else {kind: self.fresh - 1}


def satisfiable(conditions: list) -> bool:
    """False only if the conditions (pred, x, y, holds) on one value and constants exclude each other."""
    flip = {"EQ": "NE", "NE": "EQ", "SLT": "SGE", "SGE": "SLT", "SGT": "SLE", "SLE": "SGT"}
    swap = {"SLT": "SGT", "SGT": "SLT", "SLE": "SGE", "SGE": "SLE"}
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    not_: dict[str, set] = {}
    pairs: dict[tuple[str, str], set] = {}
    number = lambda v: v["Int"] if isinstance(v, dict) and "Int" in v else 0 if v == "Null" else None
    for pred, x, y, holds in conditions:
        pred = pred.replace("U", "S") if pred[0] == "U" else pred
        if not holds:
            pred = flip.get(pred, "")
        a, b = number(x), number(y)
        if a is not None and b is not None:
            if not {"EQ": a == b, "NE": a != b, "SLT": a < b, "SLE": a <= b, "SGT": a > b, "SGE": a >= b}.get(pred, True):
                return False
            continue
        if a is not None:
            x, y, b, pred = y, x, a, swap.get(pred, pred)
        if b is None:
            key = tuple(sorted((text(x), text(y))))
            if key[0] == key[1]:
                if pred in ("NE", "SLT", "SGT"):
                    return False
                continue
            said = pairs.setdefault(key, set())
            said.add(pred if pred in ("EQ", "NE") else "")
            if {"EQ", "NE"} <= said:
                return False
            continue
        k = text(x)
        if pred in ("EQ", "SGE", "SGT"):
            low[k] = max(low.get(k, float("-inf")), b + (pred == "SGT"))
        if pred in ("EQ", "SLE", "SLT"):
            high[k] = min(high.get(k, float("inf")), b - (pred == "SLT"))
        if pred == "NE":
            not_.setdefault(k, set()).add(b)
        a, z = low.get(k, float("-inf")), high.get(k, float("inf"))
        if a > z or a == z and a in not_.get(k, ()):
            return False
    return True


class Slice:
    """A program restricted to a slice, run from its entry."""

    def __init__(self, ir: dict[str, dict[str, list]], entry: str, target: str, limits: Limits, check: bool = True) -> None:
        self.ir, self.entry, self.target, self.limits, self.check = ir, entry, target, limits, check
        # Blocks are numbered in the order in which the function lists them; the first is its entry.
        self.number = {f: {b: i for i, b in enumerate(blocks)} for f, blocks in ir.items()}
        self.first = {f: next(iter(blocks)) for f, blocks in ir.items()}
        self.rng = None if limits.seed is None else random.Random(limits.seed)
        self.work: list[State] = []

    def value(self, s: State, v: Any) -> Any:
        f = s.frames[-1]
        if isinstance(v, dict):
            if "reg" in v:
                return f.regs.get(v["reg"], "Unknown")
            if "arg" in v:
                return f.args[v["arg"]] if v["arg"] < len(f.args) else {"Arg": v["arg"]}
            if "glob" in v:
                return {"Glob": v["glob"]}
            if "func" in v:
                return {"Func": v["func"]}
            return v
        return "Null" if v is None else {"Int": int(v)} if isinstance(v, (int, float)) else v

    def traces(self) -> Iterator[list[dict]]:
        """Rows of the paths that meet the target, return, are possible and differ."""
        self.work = [State([Frame(self.entry, self.first[self.entry])])]
        seen, found, explored = set(), 0, 0
        while self.work and found < self.limits.traces and explored < self.limits.explored:
            if self.rng is not None:
                k = self.rng.randrange(len(self.work))
                self.work[k], self.work[-1] = self.work[-1], self.work[k]
            s, explored = self.work.pop(), explored + 1
            if self.run(s) != "returned" or s.target is None or self.check and not satisfiable(s.conditions):
                continue
            key = tuple(s.blocks)
            if key not in seen:
                seen.add(key)
                found += 1
                yield [r | {"idx": i, "is_target": i == s.target} for i, r in enumerate(s.rows)]

    def run(self, s: State) -> str:
        while len(s.rows) < self.limits.instrs:
            f = s.frames[-1]
            code = self.ir[f.func][f.block]
            if f.pos == 0:
                s.blocks.append((f.func, f.block))
            if f.pos >= len(code):
                return "unreachable"
            end = self.step(s, f, code[f.pos])
            if end:
                return end
        return "too long"

    def jump(self, f: Frame, block: str) -> None:
        f.before, f.block, f.pos = f.block, block, 0

    def back(self, f: Frame, block: str) -> bool:
        return self.number[f.func].get(block, -1) <= self.number[f.func][f.block]

    def fork(self, s: State, f: Frame, block: str, taken: Any, condition: Any = None, row: dict | None = None) -> None:
        if len(self.work) < self.limits.work:
            other = deepcopy(s)
            other.taken.add(taken)
            if condition is not None:
                other.conditions.append(condition)
            if row:
                other.rows[-1] |= row
            self.jump(other.frames[-1], block)
            self.work.append(other)

    def step(self, s: State, f: Frame, code: dict) -> str | None:
        op, a, f.pos = code["op"], code["a"], f.pos + 1
        put = lambda v: f.regs.__setitem__(code["dst"], v)
        row = lambda kind, **more: s.rows.append({"loc": code["loc"], "op": kind, "beg_loop": False, "end_loop": False} | more)
        if op == "alloca":
            put(s.new("Alloc"))
        elif op == "load":
            place = self.value(s, a[0])
            v = s.memory.setdefault(text(place), None) or s.new("Sym")
            s.memory[text(place)] = v
            put(v)
            row("Load", mem=text(place), res=text(v))
        elif op == "store":
            place, v = self.value(s, a[0]), self.value(s, a[1])
            s.memory[text(place)] = v
            row("Store", mem=text(place), val=text(v))
        elif op == "gep":
            place = self.value(s, a[0])
            v = {"GEP": {"indices": [self.value(s, x) for x in a[1:]], "loc": place}}
            put(v)
            row("GEP", mem=text(place), res=text(v))
        elif op == "bin":
            x, y = self.value(s, a[1]), self.value(s, a[2])
            v = {"Bin": {"op": a[0], "op0": x, "op1": y}}
            put(v)
            row("Bin", op0=text(x), op1=text(y), res=text(v))
        elif op == "cast":
            v = self.value(s, a[0])
            put(v)
            row("Una", op0=text(v), res=text(v))
        elif op == "icmp":
            x, y = self.value(s, a[1]), self.value(s, a[2])
            v = {"ICmp": {"op0": x, "op1": y, "pred": a[0]}}
            put(v)
            row("ICmp", pred=a[0], op0=text(x), op1=text(y), res=text(v))
        elif op == "phi":
            put(next((self.value(s, v) for v, block in a if block == f.before), "Unknown"))
        elif op == "br" and len(a) == 1:
            row("UncondBr", end_loop=self.back(f, a[0]))
            self.jump(f, a[0])
        elif op == "br":
            return self.branch(s, f, row, *a)
        elif op == "switch":
            row("Switch", cond=text(self.value(s, a[0])))
            for block in a[2:]:
                way = (f.func, f.block, block)
                if way not in s.taken:
                    self.fork(s, f, block, way)
            self.jump(f, a[1])
        elif op == "call":
            return self.call(s, f, row, code, a)
        elif op == "ret":
            v = self.value(s, a[0]) if a else None
            row("Ret", **({"op0": text(v)} if a else {}))
            done = s.frames.pop()
            if not s.frames:
                s.frames.append(done)
                return "returned"
            if a and done.dst is not None:
                s.frames[-1].regs[done.dst] = v
                s.rows[done.row]["res"] = text(v)
        elif op == "unreachable":
            return "unreachable"
        return None

    def branch(self, s: State, f: Frame, row: Any, cond: Any, then: str, other: str) -> str | None:
        v = self.value(s, cond)
        compared = v["ICmp"] if isinstance(v, dict) and "ICmp" in v else None
        loop = any(self.back(f, b) for b in (then, other))
        row("CondBr", cond=text(v), br="Then", beg_loop=loop)
        holds = lambda h: (compared["pred"], compared["op0"], compared["op1"], h) if compared and not loop else None
        ways = [(br, block) for br, block in (("Then", then), ("Else", other)) if (f.func, f.block, br) not in s.taken]
        if not ways:
            return "explored"
        br, block = ways[0]
        if len(ways) > 1:
            self.fork(s, f, other, (f.func, f.block, "Else"), holds(False), {"br": "Else", "beg_loop": False})
        s.taken.add((f.func, f.block, br))
        s.rows[-1]["br"] = br
        if (condition := holds(br == "Then")) is not None:
            s.conditions.append(condition)
        self.jump(f, block)
        return None

    def call(self, s: State, f: Frame, row: Any, code: dict, a: list) -> None:
        name = a[0]["func"] if isinstance(a[0], dict) and "func" in a[0] else None
        if name and any(d in name for d in DUMMY) and name.startswith("llvm."):
            return
        args = [self.value(s, x) for x in a[1:]]
        row("Call", func=name or text(self.value(s, a[0])), args=[text(x) for x in args])
        if name == self.target and s.target is None:
            s.target = len(s.rows) - 1
        if name in self.ir and name != self.target and all(x.func != name for x in s.frames) and len(s.frames) < self.limits.depth:
            s.frames.append(Frame(name, self.first[name], args=args, dst=code["dst"], row=len(s.rows) - 1))
        elif code["dst"] is not None:
            v = {"Call": {"args": args, "func": {"Func": name} if name else "FuncPtr", "id": s.fresh}}
            s.fresh += 1
            f.regs[code["dst"]] = v
            s.rows[-1]["res"] = text(v)


def execute(slices: DataFrame, ir: DataFrame, limits: Limits = Limits(), check: bool = True) -> DataFrame:
    """trace_instrs rows of all slices (target, bc, slice_id, entry, functions)."""
    key = ["target", "bc", "slice_id"]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        program: dict[str, dict[str, list]] = {}
        if "block_no" not in rows:
            numbers = rows["block"].map(lambda b: int(m[0]) if (m := re.search(r"\d+", b)) else -1)
            rows = rows.assign(block_no=numbers)
        for r in rows.sort_values(["func", "block_no", "block", "pos"]).itertuples():
            program.setdefault(r.func, {}).setdefault(r.block, []).append({"op": r.op, "dst": r.dst, "a": json.loads(r.a), "loc": r.loc})
        head, out = rows.iloc[0], []
        if head["entry"] in program:
            for n, trace in enumerate(Slice(program, head["entry"], head["target"], limits, check).traces()):
                out += [{k: None for k in names} | {k: head[k] for k in key} | {"trace_id": n} | r for r in trace]
        return pd.DataFrame(out, columns=names)

    members = slices.select(*key, "entry", F.explode(F.array_union("functions", F.array("entry"))).alias("func"))
    return members.join(ir, ["bc", "func"]).groupBy(*key).applyInPandas(run, SCHEMA)
