"""Matching of linear paths by chained range joins.

Time is cut into buckets at least as wide as the window over `splits`. A partial match keeps the bucket of its first
event; every event is offered to the buckets that a match holding it may have begun in. So each step is an equi-join
on the first event's bucket (and on attributes that equalities tie to an earlier variable) with a range condition, and
all steps of a path use one partitioning: only events are shuffled, never partial matches.

ANY keeps every extension. NEXT keeps the first one of each run: the least (time, sequence). Where no comparison decides
which event that is, the variables of a path are found in one sorted pass over the candidates of each bucket, in time
linear in them; where one does, by a join and a pre-aggregated minimum. Both follow the total order (time, sequence), so an
event binds one variable of a match at most. A loop that no comparison touches is numbered in such a pass too, and each of its
events knows what follows it, so matches are written as pairs of a beginning and a last event, which nothing sorts again.
Under ANY, in paths of three variables or more, variables that no comparison ties are bound after the others, by their place
among the candidates of the bucket, and the last of them is a stretch of a sorted list there, of which no event is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket
from ..plans.parser import ANY, NEXT
from ..plans.patterns import NOT, ONE, PLUS, STAR, Path, Var
from ..plans.predicates import Compare, Range

#: Events of a list at most; the candidates of a bucket are cut into as many lists as they fill.
LIST = 4096


def name(var: str, attr: str) -> str:
    return f"{var}__{attr}"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass
class Matcher:
    """events: _type, _ts, _seq and attributes (EventTable.events)."""

    events: DataFrame
    ranges: tuple[Range, ...]
    compares: tuple[Compare, ...]
    window: int
    strategy: str = ANY
    splits: int = 1
    arrays: bool = False  # whether variables of loops keep the sequence numbers of all their events
    where: dict[str, Column] = field(default_factory=dict)  # further conditions on the events that may bind a variable

    @property
    def width(self) -> int:
        return max(1, -(-self.window // self.splits))

    def attributes(self, var: str) -> list[str]:
        """Attributes of a variable that comparisons need."""
        return sorted({side.attr for c in self.compares for side in (c.left, c.right) if side.var == var})

    def _own(self, v: Var) -> list[Column]:
        """The conditions on the events of one variable alone."""
        own = [r.column(F.col(r.attr)) for r in self.ranges if r.var == v.name]
        own += [c.column(lambda _, a: F.col(a)) for c in self.compares if c.vars == {v.name}]
        return own + ([self.where[v.name]] if v.name in self.where else [])

    def candidates(self, v: Var) -> DataFrame:
        """The events that may bind v: its type and ranges (and comparisons with itself), in the columns v__..."""
        found = self.events.filter(_all([F.col("_type") == v.type, *self._own(v)]))
        return found.select(F.col("_ts").alias(name(v.name, "ts")), F.col("_seq").alias(name(v.name, "seq")), *(F.col(a).alias(name(v.name, "a_" + a)) for a in self.attributes(v.name)))

    def _offered(self, v: Var) -> DataFrame:
        """Candidates of a later variable in each bucket that their match may have begun in."""
        reach = self.splits if self.window else 0
        found = self.candidates(v).withColumn("_b", bucket(F.col(name(v.name, "ts")), self.width))
        if not reach:
            return found.withColumnRenamed("_b", "_of")
        return found.withColumn("_of", F.explode(F.array(*(F.col("_b") - i for i in range(reach + 1))))).drop("_b")

    def _conditions(self, v: Var, bound: list[Var]) -> list[Column]:
        names = {b.name for b in bound}
        column = lambda var, attr: F.col(name(var, "a_" + attr))
        root = self._equal_to(bound)
        out = []
        for c in self.compares:
            if v.name not in c.vars or len(c.vars) < 2 or not c.vars - {v.name} <= names:
                continue
            if c.equality:
                mine, other = (c.left, c.right) if c.left.var == v.name else (c.right, c.left)
                first = root.get((other.var, other.attr), (other.var, other.attr))
                out.append(column(v.name, mine.attr) == column(*first))
            else:
                out.append(c.column(column))
        return out

    def _equal_to(self, bound: list[Var]) -> dict[tuple[str, str], tuple[str, str]]:
        """For attributes that equalities tie to an earlier variable, the earliest one: later joins use its column too,
        and so keep the partitioning. Variables that may be unbound are left as they are."""
        order = {b.name: i for i, b in enumerate(bound) if b.kind in (ONE,)}
        root: dict[tuple[str, str], tuple[str, str]] = {}
        for c in sorted((c for c in self.compares if c.equality and len(c.vars) == 2 and c.vars <= set(order)), key=lambda c: max(order[v] for v in c.vars)):
            a, b = sorted(((c.left.var, c.left.attr), (c.right.var, c.right.attr)), key=lambda x: order[x[0]])
            root[b] = root.get(a, a)
        return root

    def _first(self, v: Var) -> DataFrame:
        return self.candidates(v).withColumn("_of", bucket(F.col(name(v.name, "ts")), self.width))

    def _after(self, v: Var, before: Column, before_seq: Column, start: Column) -> list[Column]:
        ts, seq = F.col(name(v.name, "ts")), F.col(name(v.name, "seq"))
        return [(ts > before) | (ts == before) & (seq > before_seq), ts <= start + self.window]

    def run(self, path: Path) -> DataFrame:
        """The matches of a path: ts and seq of every variable (and k, the number of events, of loops)."""
        if self._loop_place(path):
            return self._looped(path, self._loop_place(path))
        if self._free(path):
            return self._listed(path, self._free(path))
        first = path[0]
        plain = self._plain_prefix(path) if self.strategy == NEXT else 1
        if plain > 1:
            out = self._chain(path[:plain])
        else:
            out = self._first(first).withColumns({"_start": F.col(name(first.name, "ts")), "_end": F.col(name(first.name, "ts")), "_end_seq": F.col(name(first.name, "seq"))})
        guarded = self._guarded(path)
        if guarded:
            out = self._until_first(out, first, path[1])
        elif self._dealt(path):
            out = out.repartition(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_of")
        bound, keys, pending = list(path[:plain]), [name(first.name, "seq")], None
        for v in path[plain:]:
            if v.kind == NOT:
                pending = None if guarded and v is path[1] else v
                continue
            if v.kind in (PLUS, STAR):
                out, keys = self._loop(out, v, bound, keys)
            else:
                before = ("_end", "_end_seq")
                if pending is not None:
                    out = out.withColumns({"_gap": F.col("_end"), "_gap_seq": F.col("_end_seq")})
                out = self._step(out, v, bound, keys, before)
                if guarded and len(bound) == 1:
                    stop, ts, seq = F.col("_stop"), F.col(name(v.name, "ts")), F.col(name(v.name, "seq"))
                    out = out.filter(stop.isNull() | (ts < stop["ts"]) | (ts == stop["ts"]) & (seq <= stop["seq"])).drop("_stop")
                if self.strategy == ANY:
                    keys = [*keys, name(v.name, "seq")]
            bound.append(v)
            if pending is not None:
                out = self._without(out, pending, v, bound)
                pending = None
        keep = [c for v in bound for c in ([name(v.name, "ts"), name(v.name, "seq")] + ([name(v.name, "k")] if v.kind in (PLUS, STAR) else []) + ([name(v.name, "seqs")] if self.arrays and v.kind in (PLUS, STAR) else []))]
        return out.select(*keep)

    def _key_classes(self, chain: Path) -> list[dict[str, str]] | None:
        """Attributes by variable that equalities make one key of all of them; None if another comparison is among them."""
        names = {v.name for v in chain}
        within = [c for c in self.compares if len(c.vars) == 2 and c.vars <= names]
        root = self._equal_to(list(chain))
        classes: dict[tuple[str, str], dict[str, str]] = {}
        for c in within:
            if not c.equality:
                return None
            for side in (c.left, c.right):
                at = (side.var, side.attr)
                if classes.setdefault(root.get(at, at), {}).setdefault(side.var, side.attr) != side.attr:
                    return None
        return list(classes.values()) if all(set(x) == names for x in classes.values()) else None

    def _plain_prefix(self, path: Path) -> int:
        """How many variables a sorted pass can bind: plain ones that nothing but a common key ties to each other."""
        n = next((i for i, v in enumerate(path) if v.kind != ONE), len(path))
        while n > 1 and self._key_classes(path[:n]) is None:
            n -= 1
        return n

    def _chain(self, chain: Path) -> DataFrame:
        """The first candidate of each variable after that of the one before, by one shuffle and one sort.

        Read from the latest to the earliest, the last candidate of the next variable is the one that follows. Of the
        rows of one event, that of a later variable is read after that of an earlier one, and so does not follow it.
        """
        classes = self._key_classes(chain) or []
        rows = None
        for i, v in enumerate(chain):
            found = self._offered(v) if i else self._first(v)
            own = [name(v.name, "ts"), name(v.name, "seq"), *(name(v.name, "a_" + a) for a in self.attributes(v.name))]
            keys = [F.col(name(v.name, "a_" + x[v.name])).alias(f"_key{k}") for k, x in enumerate(classes)]
            found = found.select("_of", *keys, F.lit(i).alias("_place"), F.col(own[0]).alias("_at"), F.col(own[1]).alias("_at_seq"), F.struct(*own).alias(f"_own{i}"))
            rows = found if rows is None else rows.unionByName(found, allowMissingColumns=True)
        for k in range(len(classes)):
            rows = rows.filter(F.col(f"_key{k}").isNotNull())
        order = Window.partitionBy("_of", *(f"_key{k}" for k in range(len(classes)))).orderBy(F.desc("_at"), F.desc("_at_seq"), "_place")
        follows = order.rowsBetween(Window.unboundedPreceding, -1)
        last = len(chain) - 1
        tail = F.struct(F.col(f"_own{last}").alias("own"))
        for i in range(last - 1, -1, -1):
            rows = rows.withColumn(f"_next{i}", F.last(F.when(F.col("_place") == i + 1, tail), ignorenulls=True).over(follows))
            tail = F.struct(F.col(f"_own{i}").alias("own"), F.col(f"_next{i}").alias("next"))
        start = F.col("_own0")[name(chain[0].name, "ts")]
        end, path_of = F.col("_next0"), [F.col("_own0")]
        for i in range(1, len(chain)):
            path_of.append(end["own"])
            end = end["next"] if i < last else end
        end_ts, end_seq = path_of[-1][name(chain[-1].name, "ts")], path_of[-1][name(chain[-1].name, "seq")]
        found = rows.filter((F.col("_place") == 0) & end_ts.isNotNull() & (end_ts <= start + self.window))
        each = [own[c].alias(c) for own, v in zip(path_of, chain, strict=True) for c in (name(v.name, "ts"), name(v.name, "seq"), *(name(v.name, "a_" + a) for a in self.attributes(v.name)))]
        return found.select("_of", *each, start.alias("_start"), end_ts.alias("_end"), end_seq.alias("_end_seq"))

    def _loop_place(self, path: Path) -> int:
        """The place of the one loop of a path that sorted passes can match under NEXT: all other variables are plain and no
        comparison ties two of them. 0 if there is none."""
        names = {v.name for v in path}
        loops = [i for i, v in enumerate(path) if v.kind in (PLUS, STAR)]
        tied = any(len(c.vars) == 2 and c.vars <= names for c in self.compares)
        if self.strategy != NEXT or self.arrays or tied or len(loops) != 1 or any(v.kind == NOT for v in path):
            return 0
        return loops[0]

    def _placed(self, path: Path) -> DataFrame:
        """_at, _at_seq, _place and _of: each event at every place of the path that it may bind, in each bucket that its
        match may have begun in; one scan."""
        reach = self.splits if self.window else 0
        fits = [_all([F.col("_type") == v.type, *self._own(v)]) for v in path]
        at = bucket(F.col("_ts"), self.width)
        places = [F.when(fit, F.struct(F.lit(i).alias("place"), (at - back).alias("of"))) for i, fit in enumerate(fits) for back in range(1 + (reach if i else 0))]
        rows = self.events.filter(reduce(lambda a, b: a | b, fits)).select(F.col("_ts").alias("_at"), F.col("_seq").alias("_at_seq"), F.explode(F.array(*places)).alias("_p"))
        return rows.filter(F.col("_p").isNotNull()).select("_at", "_at_seq", F.col("_p.place").alias("_place"), F.col("_p.of").alias("_of"))

    def _looped(self, path: Path, loop: int) -> DataFrame:
        """NEXT matches of a path with a loop at the place `loop`.

        One pass over a bucket, from the latest event to the earliest, finds what follows each event, as `_chain` does, and
        counts the loop's events behind it: the difference of two counts is the place of an event in a run. So a match is a
        pair of a beginning, which ends before the loop, and the last event of the run with what follows that.
        """
        last, v = len(path) - 1, path[loop]
        order = Window.partitionBy("_of").orderBy(F.desc("_at"), F.desc("_at_seq"), "_place")
        follows = order.rowsBetween(Window.unboundedPreceding, -1)
        here = F.struct("_at", "_at_seq")
        rows = self._placed(path).filter(F.col("_of").isNotNull())  # as the join asks of its sides, so that what stands beside it shares their shuffle
        rows = rows.withColumn("_behind", F.count(F.when(F.col("_place") == loop, 1)).over(follows))
        chain = {last: F.array(here)}  # by place: the event and those that follow it
        for i in range(last - 1, loop, -1):
            rows = rows.withColumn(f"_next{i}", F.last(F.when(F.col("_place") == i + 1, chain[i + 1]), ignorenulls=True).over(follows))
            chain[i] = F.concat(F.array(here), F.col(f"_next{i}"))
        rows = rows.withColumn("_rest", F.last(F.when(F.col("_place") == loop + 1, chain[loop + 1]), ignorenulls=True).over(follows))
        begun = F.struct(F.array(here).alias("own"), F.col("_behind").alias("behind"), F.col("_rest").alias("rest"))
        for i in range(loop - 2, -1, -1):
            rows = rows.withColumn(f"_begun{i}", F.last(F.when(F.col("_place") == i + 1, begun), ignorenulls=True).over(follows))
            begun = F.struct(F.concat(F.array(here), F.col(f"_begun{i}.own")).alias("own"), F.col(f"_begun{i}.behind").alias("behind"), F.col(f"_begun{i}.rest").alias("rest"))
        # one shuffle and sort for both sides of the pairs
        sides = rows.select("_of", "_place", "_at", "_at_seq", "_behind", "_rest", F.when(F.col("_place") == 0, begun).alias("_begun"))
        event = lambda column, u: [column["_at"].alias(name(u.name, "ts")), column["_at_seq"].alias(name(u.name, "seq"))]
        began = sides.filter((F.col("_place") == 0) & F.col("_begun.behind").isNotNull() & F.col("_begun.own").isNotNull())
        began = began.select("_of", (F.col("_at") + self.window).alias("_until"), F.col("_begun.behind").alias("_from"), F.col("_begun.rest").alias("_skip"), *(c for i in range(loop) for c in event(F.col("_begun.own")[i], path[i])))
        ended = lambda rest: rest[last - loop - 1]["_at"]
        run = sides.filter((F.col("_place") == loop) & F.col("_rest").isNotNull())
        run = run.select(F.col("_of").alias("_run_of"), F.col("_behind").alias("_left"), ended(F.col("_rest")).alias("_ended"), *event(here, v), *(c for i in range(loop + 1, last + 1) for c in event(F.col("_rest")[i - loop - 1], path[i])))
        keep = [name(u.name, x) for u in path for x in (("ts", "seq", "k") if u is v else ("ts", "seq"))]
        # neighbouring beginnings share most of what follows: with the run's side outside, few columns change from row to row as written
        pairs = run.join(began.drop("_skip"), (F.col("_of") == F.col("_run_of")) & (F.col("_left") < F.col("_from")) & (F.col("_ended") <= F.col("_until")))
        out = pairs.withColumn(name(v.name, "k"), F.col("_from") - F.col("_left")).select(*keep)
        if v.kind == STAR:
            skipped = began.filter(ended(F.col("_skip")) <= F.col("_until"))
            empty = {name(v.name, "ts"): F.lit(None).cast("long"), name(v.name, "seq"): F.lit(None).cast("long"), name(v.name, "k"): F.lit(0).cast("long")}
            after = {c: F.col("_skip")[i - loop - 1][x] for i in range(loop + 1, last + 1) for c, x in ((name(path[i].name, "ts"), "_at"), (name(path[i].name, "seq"), "_at_seq"))}
            out = out.unionByName(skipped.withColumns(empty | after).select(*keep))
        return out

    def _free(self, path: Path) -> list[int]:
        """The places of a path under ANY whose events are stretches of sorted lists: those of variables that no comparison ties
        to another, where all variables are plain and tied by no equality."""
        if not self._dealt(path) or any(v.kind != ONE for v in path):
            return []
        names = {v.name for v in path}
        tied = {x for c in self.compares if len(c.vars) == 2 and c.vars <= names for x in c.vars}
        return [i for i, v in enumerate(path) if i and v.name not in tied]

    def _ranked(self, path: Path, place: int, low: list[int] = (), high: list[int] = (), until: list[int] = ()) -> DataFrame:
        """The candidates of a place (_ts, _seq and attributes) in each bucket that their match may have begun in, with how many of
        the candidates of other places stand there before one that the event may precede (_low{i}), may precede the event
        (_high{i}) or stand up to the end of the window that it begins (_until{i}); one shuffle of these events."""
        needed = sorted({place, *low, *high, *until})
        fits = {i: F.coalesce(_all([F.col("_type") == path[i].type, *self._own(path[i])]), F.lit(False)) for i in needed}
        at, reach = bucket(F.col("_ts"), self.width), self.splits if self.window else 0
        rows = self.events.filter(reduce(lambda a, b: a | b, fits.values())).select("_ts", "_seq", *self.attributes(path[place].name), at.alias("_b"), *(fit.alias(f"_fits{i}") for i, fit in fits.items()))
        rows = rows.withColumn("_of", F.explode(F.array(*(F.col("_b") - i for i in range(reach + 1))))).filter(F.col("_of").isNotNull())
        if not place:
            rows = rows.withColumn("_fits0", F.col("_fits0") & (F.col("_b") == F.col("_of")))
            rows = rows.filter(reduce(lambda a, b: a | b, (F.col(f"_fits{i}") for i in needed)))
        rows = rows.drop("_b").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_of")
        times = Window.partitionBy("_of").orderBy("_ts")
        order = Window.partitionBy("_of").orderBy("_ts", "_seq")
        first, here = Window.unboundedPreceding, Window.currentRow
        of = lambda i: F.count(F.when(F.col(f"_fits{i}"), 1))
        ranks = {f"_until{i}": of(i).over(times.rangeBetween(first, self.window)) for i in until}
        for i in low:  # of one time, an event without a number precedes none
            ranks[f"_low{i}"] = F.when(F.col("_seq").isNull(), of(i).over(times.rangeBetween(first, here))).otherwise(of(i).over(order.rangeBetween(first, here)))
        for i in high:
            ranks[f"_high{i}"] = of(i).over(order.rangeBetween(first, here)) - of(i).over(order.rangeBetween(here, here))
        return rows.withColumns(ranks).filter(f"_fits{place}") if ranks else rows.filter(f"_fits{place}")

    def _listed(self, path: Path, free: list[int]) -> DataFrame:
        """ANY matches of a path with free places: the variables of the others are bound first, then the free ones from left to
        right; those of the last are read from lists, and what is joined before is ranks."""
        held, bound = [i for i in range(len(path)) if i not in free], []
        tail = [k for k in free if k > held[-1]]
        for i in held:
            v = path[i]
            low, high = [k for k in (i + 1,) if k in free], [k for k in free if bound and held[len(bound) - 1] < k < i]
            until = tail if not i else []
            rows = self._ranked(path, i, low, high, until)
            found = rows.select("_of", F.col("_ts").alias(name(v.name, "ts")), F.col("_seq").alias(name(v.name, "seq")), *(F.col(a).alias(name(v.name, "a_" + a)) for a in self.attributes(v.name)), *(f"_low{k}" for k in low), *(f"_high{k}" for k in high), *(F.col(f"_until{k}").alias(f"_high{k}") for k in until))
            if bound:
                out = self._extended(out, v, bound, (name(bound[-1].name, "ts"), name(bound[-1].name, "seq")), found)
            else:
                out = found.withColumn("_start", F.col(name(v.name, "ts")))
            bound.append(v)
        for i in free:
            v, low = path[i], [k for k in (i + 1,) if k in free]
            ends = next((path[k] for k in held if k > i), None)
            ts, seq = name(v.name, "ts"), name(v.name, "seq")
            if i != free[-1]:
                found = self._ranked(path, i, low).select(F.col("_of").alias("_of_it"), F.col("_ts").alias(ts), F.col("_seq").alias(seq), self._number().alias("_at"), *(f"_low{k}" for k in low))
                out = out.join(found, (F.col("_of") == F.col("_of_it")) & (F.col("_at") >= F.col(f"_low{i}")) & (F.col("_at") < F.col(f"_high{i}"))).drop("_of_it", "_at")
            else:
                low, high = F.greatest(f"_low{i}", "_from"), F.least(f"_high{i}", "_to")
                out = out.join(self._lists(path, i), (F.col("_of") == F.col("_of_it")) & (low < high))
                stretch = F.sequence((low - F.col("_from")).cast("int"), (high - F.col("_from") - 1).cast("int"))
                out = out.withColumn("_k", F.explode(F.when(low < high, stretch)))
                out = out.withColumns({ts: F.col("_tss")[F.col("_k")], seq: F.col("_seqs")[F.col("_k")]})
            if ends is not None:  # of one time, what has no number precedes nothing
                out = out.filter(F.col(seq).isNotNull() | (F.col(ts) < F.col(name(ends.name, "ts"))))
        return out.select(*(name(v.name, x) for v in path for x in ("ts", "seq")))

    def _number(self) -> Column:
        """The place of a candidate in its bucket, from 0."""
        return F.row_number().over(Window.partitionBy("_of").orderBy("_ts", "_seq")) - 1

    def _lists(self, path: Path, place: int) -> DataFrame:
        """The candidates of a free place in each bucket, in order, from the number _from up to _to, LIST at most in a list."""
        found = self._ranked(path, place).select("_of", self._number().alias("_at"), "_ts", "_seq")
        lists = found.groupBy("_of", F.floor(F.col("_at") / LIST).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("_at", "_ts", "_seq"))).alias("_list"))
        first = F.col("_list")[0]["_at"]
        return lists.select(F.col("_of").alias("_of_it"), first.cast("long").alias("_from"), (first + F.size("_list")).cast("long").alias("_to"), F.col("_list._ts").alias("_tss"), F.col("_list._seq").alias("_seqs"))

    def _extended(self, out: DataFrame, v: Var, bound: list[Var], before: tuple[str, str], offered: DataFrame | None = None) -> DataFrame:
        offered = self._offered(v) if offered is None else offered
        on = [out["_of"] == offered["_of"], *self._after(v, F.col(before[0]), F.col(before[1]), F.col("_start")), *self._conditions(v, bound)]
        return out.join(offered, _all(on)).drop(offered["_of"])

    def _step(self, out: DataFrame, v: Var, bound: list[Var], keys: list[str], before: tuple[str, str]) -> DataFrame:
        ts, seq = name(v.name, "ts"), name(v.name, "seq")
        own = [ts, seq, *(name(v.name, "a_" + a) for a in self.attributes(v.name))]
        columns = out.columns
        joined = self._extended(out, v, bound, before)
        if self.strategy == NEXT:
            rest = [c for c in columns if c not in ("_of", *keys)]
            joined = joined.groupBy("_of", *keys).agg(*(F.first(c).alias(c) for c in rest), F.min(F.struct(*own)).alias("_x")).select(*columns, "_x.*")
        return joined.withColumns({"_end": F.col(ts), "_end_seq": F.col(seq)})

    def _loop(self, out: DataFrame, v: Var, bound: list[Var], keys: list[str]) -> tuple[DataFrame, list[str]]:
        """Prefixes of the qualifying events in order: one row for each k >= 1 (k >= 0 for a star), whose last event
        the next variable follows and later comparisons read."""
        ts, seq, k = (name(v.name, x) for x in ("ts", "seq", "k"))
        joined = self._extended(out, v, bound, ("_end", "_end_seq"))
        run = Window.partitionBy("_of", *keys).orderBy(ts, seq)
        more = {k: F.row_number().over(run).cast("long")}
        if self.arrays:
            more[name(v.name, "seqs")] = F.collect_list(seq).over(run.rowsBetween(Window.unboundedPreceding, 0))
        joined = joined.withColumns(more).withColumns({"_end": F.col(ts), "_end_seq": F.col(seq)})
        if v.kind == STAR:
            none = out.withColumn(k, F.lit(0).cast("long"))
            if self.arrays:
                none = none.withColumn(name(v.name, "seqs"), F.array().cast("array<bigint>"))
            joined = joined.unionByName(none, allowMissingColumns=True)
        return joined, [*keys, k]

    def _guarded(self, path: Path) -> bool:
        """Whether a path begins with a negation between plain variables that no comparison touches, under ANY: the first
        event that may bind it then ends what may follow the first variable."""
        if self.strategy != ANY or [v.kind for v in path[:3]] != [ONE, NOT, ONE]:
            return False
        names = {v.name for v in path}
        return not any(path[1].name in c.vars and len(c.vars) == 2 and c.vars <= names for c in self.compares)

    def _dealt(self, path: Path) -> bool:
        """Whether the joins of a path keep all shuffle partitions: those of ANY over three variables or more, by bucket alone.
        Their work is in the matches, so partitions must not be merged by how few events they hold."""
        names = {v.name for v in path}
        keyed = any(c.equality and len(c.vars) == 2 and c.vars <= names for c in self.compares)
        return self.strategy == ANY and not keyed and sum(v.kind != NOT for v in path) > 2

    def _until_first(self, out: DataFrame, first: Var, gone: Var) -> DataFrame:
        """The events of the first variable with `_stop`, the first event of the negated one after each (null if there is
        none in its buckets), by one sorted pass."""
        ts, seq = name(gone.name, "ts"), name(gone.name, "seq")
        stops = self._offered(gone).select("_of", F.col(ts).alias("_at"), F.col(seq).alias("_at_seq"), F.lit(1).alias("_place"))
        rows = out.withColumns({"_at": F.col("_end"), "_at_seq": F.col("_end_seq"), "_place": F.lit(0)}).unionByName(stops, allowMissingColumns=True)
        follows = Window.partitionBy("_of").orderBy(F.desc("_at"), F.desc("_at_seq"), "_place").rowsBetween(Window.unboundedPreceding, -1)
        stop = F.last(F.when(F.col("_place") == 1, F.struct(F.col("_at").alias("ts"), F.col("_at_seq").alias("seq"))), ignorenulls=True).over(follows)
        return rows.withColumn("_stop", stop).filter(F.col("_place") == 0).drop("_at", "_at_seq", "_place")

    def _without(self, out: DataFrame, gone: Var, last: Var, bound: list[Var]) -> DataFrame:
        """Matches with no qualifying event strictly between the variables around the negation."""
        offered = self._offered(gone)
        ts, seq = F.col(name(gone.name, "ts")), F.col(name(gone.name, "seq"))
        end, end_seq = F.col(name(last.name, "ts")), F.col(name(last.name, "seq"))
        before_last = (ts < end) | (ts == end) & (seq < end_seq)
        on = [out["_of"] == offered["_of"], *self._after(gone, F.col("_gap"), F.col("_gap_seq"), F.col("_start")), before_last, *self._conditions(gone, bound)]
        return out.join(offered, _all(on), "left_anti").drop("_gap", "_gap_seq")


def countable(matcher: Matcher, path: Path) -> bool:
    """Whether `counted` can count the matches of a path: ANY, plain variables, and no comparison that ties two of them."""
    names = {v.name for v in path}
    return matcher.strategy == ANY and all(v.kind == ONE for v in path) and not any(len(c.vars) == 2 and c.vars <= names for c in matcher.compares)


def counted(matcher: Matcher, path: Path) -> DataFrame:
    """n: the number of ANY matches of a path, without forming them; one shuffle and two sorts of the events.

    A window that begins in a bucket as wide as itself holds the rest of that bucket and the next one up to its end. So a match
    is a beginning (variables 0 to k) within the first bucket and an end (k + 1 on) within the next: running sums from the
    latest event to the earliest count the beginnings of each first event, others in order of time the ends up to a time.
    Sums are decimals of 38 digits; a larger one is an error.
    """
    m, last, many = replace(matcher, splits=1), len(path) - 1, "decimal(38,0)"
    rows = m._placed(path)
    rows = rows.withColumn("_in", bucket(F.col("_at"), m.width) == F.col("_of"))
    one, zero = F.lit(1).cast(many), F.lit(0).cast(many)
    # of one event, a later place is read before an earlier one in order of time, and after it in the other: none follows itself
    up = Window.partitionBy("_of").orderBy("_at", "_at_seq", F.desc("_place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_of").orderBy(F.desc("_at"), F.desc("_at_seq"), "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = lambda here, value, over: F.coalesce(F.sum(F.when(here, value)).over(over), zero).cast(many)
    for j in range(1, last + 1):  # _e{k}: ends from variable k to j up to an event
        here = (F.col("_place") == j) & ~F.col("_in")
        rows = rows.withColumns({f"_e{k}": summed(here, F.col(f"_e{k}") if k < j else one, up) for k in range(1, j + 1)})
    if last:  # up to the end of the window that the event begins, whatever their sequence numbers
        until = Window.partitionBy("_of").orderBy("_at").rangeBetween(Window.unboundedPreceding, m.window)
        rows = rows.withColumns({f"_e{k}": F.max(f"_e{k}").over(until) for k in range(1, last + 1)})
    for i in range(last, 0, -1):  # _b{k}: beginnings from variable i to k, from an event on
        here = (F.col("_place") == i) & F.col("_in")
        rows = rows.withColumns({f"_b{k}": summed(here, F.col(f"_b{k}") if k > i else one, down) for k in range(i, last + 1)})
    ends = {k: F.col(f"_e{k + 1}") if k < last else one for k in range(last + 1)}
    each = reduce(lambda a, b: a + b, ((F.col(f"_b{k}") if k else one) * ends[k] for k in range(last + 1)))
    return rows.filter(F.col("_place") == 0).agg(F.coalesce(F.sum(each.cast(many)).cast(many), zero).alias("n"))


def contiguous(events: DataFrame, path: Path, ranges: tuple[Range, ...], compares: tuple[Compare, ...], window: int, by: list[str] = ()) -> DataFrame:
    """Strict contiguity: the variables bind neighbouring events of the table (of each key, if `by` is given).

    Neighbours are sought within buckets as wide as the window, each with the events of the next one besides, which hold
    all that a match beginning in it may bind. So no task orders more than two windows of time.
    """
    width = max(1, window)
    order = Window.partitionBy(*by, "_of").orderBy("_ts", "_seq")
    rows = events.withColumn("_b", bucket(F.col("_ts"), width))
    rows, wanted = rows.withColumn("_of", F.explode(F.array(F.col("_b"), F.col("_b") - 1))), [F.col("_b"), F.col("_of")]
    for i, v in enumerate(path):
        if v.kind != ONE:
            raise ValueError("strict contiguity takes plain variables")
        at = lambda column, i=i: F.lead(column, i).over(order) if i else F.col(column)
        attrs = sorted({s.attr for c in compares for s in (c.left, c.right) if s.var == v.name} | {r.attr for r in ranges if r.var == v.name})
        wanted += [at("_ts").alias(name(v.name, "ts")), at("_seq").alias(name(v.name, "seq")), at("_type").alias(name(v.name, "type")), *(at(a).alias(name(v.name, "a_" + a)) for a in attrs)]
    on_path = {v.name for v in path}
    tests = [F.col(name(v.name, "type")) == v.type for v in path]
    tests += [r.column(F.col(name(r.var, "a_" + r.attr))) for r in ranges if r.var in on_path]
    tests += [c.column(lambda var, a: F.col(name(var, "a_" + a))) for c in compares if c.vars <= on_path]
    tests.append(F.col(name(path[-1].name, "ts")) <= F.col(name(path[0].name, "ts")) + window)
    return rows.select(*wanted).filter((F.col("_b") == F.col("_of")) & _all(tests)).select(*(name(v.name, x) for v in path for x in ("ts", "seq")))


def subtract(matches: DataFrame, longer: DataFrame, without: str) -> DataFrame:
    """matches less the projections of `longer`, which has the variable `without` besides: negation by subtraction."""
    rest = [c for c in longer.columns if not c.startswith(f"{without}__") and c.endswith("__seq")]
    return matches.join(longer.select(*rest).distinct(), rest, "left_anti")


def time_pairs(left: DataFrame, right: DataFrame, window: int) -> DataFrame:
    """Pairs (lts, lseq, rts, rseq) of two lists (ts, seq) with 0 <= rts - lts <= window, by buckets."""
    width = max(1, window)
    a = left.select(F.col("ts").alias("lts"), F.col("seq").alias("lseq"), bucket(F.col("ts"), width).alias("la"))
    b = right.select(F.col("ts").alias("rts"), F.col("seq").alias("rseq"), bucket(F.col("ts"), width).alias("_b"))
    b = b.withColumn("ra", F.explode(F.array(F.col("_b"), F.col("_b") - 1))).drop("_b")
    return a.join(b, (F.col("la") == F.col("ra")) & (F.col("rts") >= F.col("lts")) & (F.col("rts") <= F.col("lts") + window)).drop("la", "ra")
