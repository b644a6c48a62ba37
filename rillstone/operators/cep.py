"""Complex events: patterns of named states with sequence, alternatives, negation, loops, related values and time limits, and explicit automata.

A loop may take any number of events. Where a pattern ends in a loop or a negation, a run that could end is kept open until its time is over or the rows are, and then counts: a loop
has then taken all that came, and what is negated has not come.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An event as a dict, and the run so far: its events and related values.
Test = Callable[[dict, "Run"], bool]
STRATEGIES = ("first", "next", "contiguous", "recent", "all")


@dataclass
class Run:
    events: list[dict] = field(default_factory=list)
    at: int = 0
    loops: int = 0
    #: The step that took each event, and which alternative of the pattern this is.
    steps: list[int] = field(default_factory=list)
    branch: int = 0

    def previous(self, name: str):
        return self.events[-1][name] if self.events else None

    def related(self, name: str, f: Callable = sum, step: int | None = None):
        """f over a column of the run's events, or of those that one step took."""
        values = [e[name] for e, s in zip(self.events, self.steps, strict=True) if step is None or s == step]
        return f(values) if values else None

    def copy(self) -> Run:
        return Run(list(self.events), self.at, self.loops, list(self.steps), self.branch)


@dataclass(frozen=True)
class Limit:
    """A column of the event that step end takes (None: of any later event) is at most span above that of the first event of step start."""

    column: str
    span: float
    start: int = 0
    end: int | None = None


@dataclass(frozen=True)
class Pattern:
    """Alternatives of steps: (test, least, most) with most None for any number, or (test, -1, -1) for an event that must not come."""

    branches: tuple[tuple[tuple[Test, int, int | None], ...], ...]
    limits: tuple[Limit, ...] = ()

    def __rshift__(self, other: Pattern) -> Pattern:
        return Pattern(tuple(a + b for a in self.branches for b in other.branches), self.limits + other.limits)

    def __or__(self, other: Pattern) -> Pattern:
        return Pattern(self.branches + other.branches, self.limits + other.limits)

    def __invert__(self) -> Pattern:
        return self._loop(-1, -1)

    def _loop(self, least: int, most: int | None) -> Pattern:
        if any(len(b) != 1 or b[0][1:] != (1, 1) for b in self.branches):
            raise ValueError("loops and negation take single states or alternatives of them")
        tests = [b[0][0] for b in self.branches]
        return Pattern((((tests[0] if len(tests) == 1 else lambda e, r: any(t(e, r) for t in tests), least, most),),))

    def plus(self) -> Pattern:
        return self._loop(1, None)

    def star(self) -> Pattern:
        return self._loop(0, None)

    def optional(self) -> Pattern:
        return self._loop(0, 1)

    def times(self, n: int) -> Pattern:
        return self._loop(n, n)

    def within(self, column: str, span: float, start: int = 0, end: int | None = None) -> Pattern:
        """From the first event to the last, from that of one step to the last, or from step to step (numbered from 0)."""
        return replace(self, limits=(*self.limits, Limit(column, span, start, end)))

    def begin(self) -> list[Run]:
        return [Run(branch=i) for i in range(len(self.branches))]

    def late(self, run: Run, event: dict, step: int | None) -> bool:
        """Whether a limit forbids the event, which step takes (None: looks at)."""
        for x in self.limits:
            if x.start in run.steps and x.end in (None, step) and event[x.column] - run.events[run.steps.index(x.start)][x.column] > x.span:
                return True
        return False

    def could_end(self, run: Run) -> bool:
        steps = self.branches[run.branch]
        if not run.events:
            return False
        if run.at < len(steps) and steps[run.at][1] > run.loops:
            return False
        return all(s[1] <= 0 for s in steps[run.at + 1 :])

    def step(self, run: Run, event: dict) -> str:
        """What the event does to the run: 'on', 'done', 'skip', 'dead', or 'over' (it ended before the event)."""
        steps = self.branches[run.branch]
        if self.limits and run.events and self.late(run, event, None):
            return "over" if self.could_end(run) else "dead"
        at, loops = run.at, run.loops
        while at < len(steps):
            test, least, most = steps[at]
            if least == -1:
                if test(event, run):
                    return "dead"
                at, loops = at + 1, 0
                continue
            # A loop that may end lets the next state take the event first.
            if loops >= least and at + 1 < len(steps) and steps[at + 1][1] != -1 and steps[at + 1][0](event, run):
                at, loops = at + 1, 0
                continue
            if test(event, run):
                if self.limits and self.late(run, event, at):
                    return "skip"
                loops += 1
                run.events.append(event)
                run.steps.append(at)
                run.at, run.loops = (at + 1, 0) if most is not None and loops >= most else (at, loops)
                return "done" if run.at == len(steps) else "on"
            if loops >= least and at + 1 < len(steps):
                at, loops = at + 1, 0
                continue
            return "skip"
        return "skip"


def state(test: Callable) -> Pattern:
    """test(event) or test(event, run)."""
    two = test.__code__.co_argcount == 2
    return Pattern((((test if two else lambda e, r: test(e), 1, 1),),))


@dataclass(frozen=True)
class Nfa:
    """An automaton: edges (from, test, to) in order of preference, and forbidden (from, test), whose events end a run; tests take the event and the run."""

    start: int
    finals: tuple[int, ...]
    edges: tuple[tuple[int, Test, int], ...]
    forbidden: tuple[tuple[int, Test], ...] = ()

    def begin(self) -> list[Run]:
        return [Run(at=self.start)]

    def could_end(self, run: Run) -> bool:
        return False

    def step(self, run: Run, event: dict) -> str:
        if any(at == run.at and test(event, run) for at, test in self.forbidden):
            return "dead"
        for at, test, to in self.edges:
            if at == run.at and test(event, run):
                run.events.append(event)
                run.steps.append(at)
                run.at = to
                return "done" if to in self.finals else "on"
        return "skip"


def run_matches(rows: list[dict], p: Pattern | Nfa, strategy: str = "first", open_runs: list | None = None) -> list[list[dict]]:
    """Matches of rows in order. Events that a run cannot use are skipped.

    first: one run at a time; next: every event may also open a run; contiguous: as next, but an event that a run cannot use ends it; recent: as next, but a
    new run takes the place of those at the same state; all: every choice of events, a run goes on both with and without an event it could take.

    A run is a group of the alternatives that took its first event; the first of them to end is the match. open_runs are the runs that earlier rows left open; they go on, and what is open at
    the end takes their place in the list. Without it the rows end here.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy is called {strategy}")
    out, live, fresh = [], list(open_runs or []), p.begin()
    for event in rows:
        kept, used = [], False
        for group in live:
            left, ended = [], None
            for r in group:
                before = r.copy() if strategy == "all" else None
                said = p.step(r, event)
                used |= said in ("on", "done")
                if said in ("done", "over"):
                    ended = r.events if ended is None else ended
                elif said == "on" or (said == "skip" and strategy != "contiguous"):
                    left.append(r)
                elif said == "skip" and p.could_end(r):
                    ended = r.events if ended is None else ended
                if before is not None and said in ("on", "done"):
                    kept.append([before])
            if ended is not None:
                out.append(ended)
            elif left:
                kept.append(left)
        live = kept
        if strategy != "first" or (not live and not used):
            group, ended = [], None
            for r in fresh:
                said = p.step(r, event)
                if said == "done":
                    ended = r.events if ended is None else ended
                elif said == "on":
                    group.append(r)
            if ended is not None or group:  # what skipped the event is as it was
                fresh = p.begin()
            if ended is not None:
                out.append(ended)
            elif group:
                if strategy == "recent":
                    states = {(r.branch, r.at) for r in group}
                    live = [g for g in live if not states & {(r.branch, r.at) for r in g}]
                live.append(group)
    if open_runs is not None:
        open_runs[:] = live
        return out
    return out + [next(r.events for r in g if p.could_end(r)) for g in live if any(p.could_end(r) for r in g)]


def match(df: DataFrame, p: Pattern | Nfa, by: list[str], strategy: str = "first", output: str = "one_by_one") -> DataFrame:
    """The events of matches with _match (number within the partition) and _pos; output 'combined' gives one row for each match."""
    rows = df if by else df.withColumn("_all", F.lit(0))
    names = df.columns

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seq")[names]
        columns = [pdf[n].tolist() for n in names]
        events = [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)]
        place = {id(e): i for i, e in enumerate(events)}
        flat = [(place[id(e)], i, j) for i, m in enumerate(run_matches(events, p, strategy)) for j, e in enumerate(m)]
        out = pdf.iloc[[x for x, _, _ in flat]]
        return out.assign(_match=[i for _, i, _ in flat], _pos=[j for _, _, j in flat])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _match long, _pos long"
    out = rows.groupBy(*(by or ["_all"])).applyInPandas(find, ddl)
    if output == "combined":
        return out.groupBy(*by, "_match").agg(F.sort_array(F.collect_list(F.struct("_pos", *[n for n in names if n not in by]))).alias("events"))
    return out
