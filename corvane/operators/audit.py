"""Audit of an answer against a table of facts.

Facts are rows of text columns.  Two periods of one metric are compared by groups:
what changed, by how much, and which share of the whole change each group and each of
its key values made.  The answer is held against that: segments that it names, the
direction that it claims, and the main driver that it may leave out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import periods as P
from corvane.functions import text as T
from corvane.functions.durable import materialize

EPSILON = 2.220446049250313e-16
PERIOD_NAMES = "period date time month quarter year week".split()
METRIC_SCORES = (
    (100, "revenue sales gmv arr mrr amount value"), (40, "usd eur gbp jpy money price"), (25, "cost expense spend"),
    (10, "orders units qty"), (-50, "rate ratio pct percent"), (-30, "traffic session visit click impression"),
)
PAIRS = [pair.split(">") for pair in "old>new previous>current prior>current before>after baseline>current past>present t0>t1".split()]
#: A column with more distinct values than this is neither a period nor a group.
MOST_VALUES = 100


class AuditError(ValueError):
    """An audit that can't be made."""


@dataclass(frozen=True)
class Request:
    """What to compare, all settled."""

    group_by: tuple[str, ...]
    metric: str
    period_col: str
    baseline: str
    current: str
    answer: str
    granularity: str = "raw"
    weak_threshold: float = 0.1
    question: str | None = None


@dataclass(frozen=True)
class Profile:
    """Columns in order, with the share of numbers and, up to a bound, the distinct values of each."""

    columns: tuple[str, ...]
    numeric_ratio: dict[str, float] = field(default_factory=dict)
    n_values: dict[str, int] = field(default_factory=dict)


# -- columns and their roles


def is_period_name(name: str) -> bool:
    return any(part in name.lower() for part in PERIOD_NAMES)


def metric_name_score(name: str) -> int:
    return sum(points for points, parts in METRIC_SCORES for part in parts.split() if part in name.lower())


def column_profile(facts: DataFrame) -> DataFrame:
    """(place, name, filled, numeric, numeric_ratio, n_values): every column, in one scan."""
    value = {c: T.trimmed(F.col(f"`{c}`").cast("string")) for c in facts.columns}
    filled = {c: F.when(v != "", v) for c, v in value.items()}
    row = facts.agg(*[x for i, v in enumerate(filled.values()) for x in (F.count(v).alias(f"f{i}"), F.count(P.plain_number(v)).alias(f"n{i}"), F.count_distinct(v).alias(f"d{i}"))])
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(f"f{i}").alias("filled"), F.col(f"n{i}").alias("numeric"), F.col(f"d{i}").alias("n_values")) for i, c in enumerate(facts.columns)])
    rows = row.select(F.explode(each).alias("x")).select("x.*")
    return rows.withColumn("numeric_ratio", F.when(F.col("filled") == 0, F.lit(0.0)).otherwise(F.col("numeric") / F.col("filled")))


def profile(facts: DataFrame) -> Profile:
    rows = column_profile(facts).orderBy("place").collect()
    return Profile(tuple(r["name"] for r in rows), {r["name"]: r["numeric_ratio"] for r in rows}, {r["name"]: r["n_values"] for r in rows})


def infer_metric(found: Profile) -> str:
    names = [c for c in found.columns if found.numeric_ratio[c] >= 0.9 and not is_period_name(c)]
    if not names:
        raise AuditError("no numeric column can serve as the metric")
    return min(names, key=lambda c: (-metric_name_score(c), c))


def infer_period(found: Profile, metric: str) -> str:
    others = [c for c in found.columns if c != metric]
    named = [c for c in others if is_period_name(c)] or [c for c in others if 2 <= found.n_values[c] <= 32]
    if not named:
        raise AuditError("no column can serve as the period")
    return named[0]


def infer_groups(found: Profile, metric: str, period_col: str) -> tuple[str, ...]:
    return tuple(c for c in found.columns if c not in (metric, period_col) and 2 <= found.n_values[c] <= MOST_VALUES)[:2]


def infer_pair(values: list[str]) -> tuple[str, str]:
    """Baseline and current among the periods: a known pair of names, else the least and the greatest."""
    if len(values) < 2:
        raise AuditError("two periods at least are needed")
    known = {v.lower(): v for v in sorted(values)}
    for a, b in PAIRS:
        if a in known and b in known:
            return known[a], known[b]
    try:
        ordered = sorted(values, key=float)
    except ValueError:
        ordered = sorted(values)
    return ordered[0], ordered[-1]


def period_values(facts: DataFrame, period_col: str, granularity: str) -> list[str]:
    period = P.period_in(facts, period_col, granularity)
    return [r[0] for r in facts.select(period.alias("p")).where("p <> ''").distinct().orderBy("p").collect()]


def _user_period(facts: DataFrame, field_name: str, value: str, granularity: str) -> str:
    made = facts.sparkSession.createDataFrame([(value,)], "v string").select(P.bucketed(F.col("v"), granularity)).first()[0]
    if granularity != "raw" and not made:
        raise AuditError(f"the {field_name} period {value!r} is no {granularity}" if value.strip() else f"the {field_name} period is empty")
    return made


def resolve(facts: DataFrame, answer: str, *, auto: bool = False, granularity: str = "raw", group_by: tuple[str, ...] | list[str] = (), metric: str | None = None, period_col: str | None = None, baseline: str | None = None, current: str | None = None, question: str | None = None, weak_threshold: float = 0.1) -> tuple[Request, list[str]]:
    """A settled request and notes on what was inferred; missing parts are inferred only with auto."""
    granularity = granularity.strip().lower()
    if granularity not in P.GRANULARITIES:
        raise AuditError(f"unknown period granularity {granularity!r}")
    if weak_threshold < 0:
        raise AuditError("the weak contribution threshold must not be below 0")
    found = profile(facts)
    notes: list[str] = []

    def settle(name: str, given: str | None, infer, is_column: bool) -> str:
        if given is not None:
            if is_column and given not in found.columns:
                raise AuditError(f"there is no column {given!r}")
            return given
        if not auto:
            raise AuditError(f"--{name.replace('_', '-')} is needed, or --auto")
        value = infer()
        notes.append(f"auto {name}: {value}")
        return value

    metric = settle("metric", metric, lambda: infer_metric(found), True)
    period_col = settle("period_col", period_col, lambda: infer_period(found, metric), True)
    values = period_values(facts, period_col, granularity)
    if len(values) < 2:
        raise AuditError(f"column {period_col!r} must have two periods at least" + (f" that are a {granularity}" if granularity != "raw" else ""))
    first, last = infer_pair(values)
    baseline = settle("baseline", baseline, lambda: first, False)
    current = settle("current", current, lambda: last if last != baseline else next(v for v in reversed(values) if v != baseline), False)
    baseline, current = _user_period(facts, "baseline", baseline, granularity), _user_period(facts, "current", current, granularity)
    if auto or granularity != "raw":
        notes.append(f"period granularity: {granularity}")
    if baseline == current:
        raise AuditError("baseline and current are the same period")
    for name, value in (("baseline", baseline), ("current", current)):
        if value not in values:
            raise AuditError(f"{name} {value!r} isn't in column {period_col!r}")
    if group_by:
        for column in group_by:
            if column not in found.columns:
                raise AuditError(f"there is no column {column!r}")
        groups = tuple(dict.fromkeys(group_by))
    elif auto:
        groups = infer_groups(found, metric, period_col)
        if not groups:
            raise AuditError("no column can serve as a group; give --group-by")
        notes.append(f"auto group_by: {','.join(groups)}")
    else:
        raise AuditError("--group-by is needed, or --auto")
    return Request(groups, metric, period_col, baseline, current, answer, granularity, weak_threshold, question), notes


# -- drivers and segments


def skipped_rows(facts: DataFrame, period_col: str, granularity: str) -> DataFrame:
    """One row: rows whose period is filled but can't be read at this granularity."""
    raw = F.col(f"`{period_col}`").cast("string")
    return facts.agg(F.count_if((P.period_in(facts, period_col, granularity) == "") & (T.trimmed(raw) != "") & F.lit(granularity != "raw")).alias("skipped"))


def drivers(facts: DataFrame, group_by: tuple[str, ...], metric: str, period_col: str, baseline: str, current: str, granularity: str = "raw") -> DataFrame:
    """(key_values, baseline, current, delta, contribution_pct), a row for each group of either period.

    A figure in one of the two periods that isn't a number ends the query with an error.
    """
    rows = facts.select(
        F.array(*[F.coalesce(T.trimmed(F.col(f"`{c}`").cast("string")), F.lit("")) for c in group_by]).alias("key_values"),
        P.period_in(facts, period_col, granularity).alias("period"), P.metric_in(facts, metric).alias("number"), F.col(f"`{metric}`").cast("string").alias("raw"),
    ).where(F.col("period").isin(baseline, current))
    value = F.coalesce("number", F.raise_error(F.concat(F.lit("no number: "), F.coalesce("raw", F.lit("")))).cast("double"))
    sums = rows.groupBy("key_values").agg(
        F.coalesce(F.sum(F.when(F.col("period") == baseline, value)), F.lit(0.0)).alias("baseline"),
        F.coalesce(F.sum(F.when(F.col("period") == current, value)), F.lit(0.0)).alias("current"),
    ).withColumn("delta", F.col("current") - F.col("baseline"))
    total = sums.agg(F.sum("delta").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("key_values", "baseline", "current", "delta", share_of(F.col("delta"), F.col("total")).alias("contribution_pct"))


def share_of(delta: Column, total: Column) -> Column:
    return F.when(F.abs(total) < EPSILON, F.lit(0.0)).otherwise(delta / total * 100.0)


def segments(driver_rows: DataFrame) -> DataFrame:
    """(segment, delta, contribution_pct): every key value with the changes of all groups that it is in."""
    summed = driver_rows.select(F.explode("key_values").alias("segment"), "delta").groupBy("segment").agg(F.sum("delta").alias("delta"))
    total = driver_rows.agg(F.sum("delta").alias("total"))
    return summed.crossJoin(F.broadcast(total)).select("segment", "delta", share_of(F.col("delta"), F.col("total")).alias("contribution_pct"))


def claimed(answer: Column) -> Column:
    found = T.direction(T.tokens(answer), T.AUDIT_UP, T.AUDIT_DOWN)
    return F.when(found == "up", "increase").when(found == "down", "decrease").otherwise("unknown")


def actual(delta: Column) -> Column:
    return F.when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("flat")


def mentions(segment_rows: DataFrame, answer: str, weak_threshold: float = 0.1) -> DataFrame:
    """(segment, claimed_direction, actual_direction, delta, contribution_pct, contradiction, weak) of the segments that the answer names."""
    tokens = T.tokens(F.lit(answer))
    rows = segment_rows.where(T.mentions(tokens, F.col("segment")))
    claim, real = claimed(F.lit(answer)), actual(F.col("delta"))
    against = ((claim == "increase") & (real == "decrease")) | ((claim == "decrease") & (real == "increase"))
    return rows.select("segment", claim.alias("claimed_direction"), real.alias("actual_direction"), "delta", "contribution_pct", against.alias("contradiction"), (F.abs("contribution_pct") < weak_threshold * 100).alias("weak"))


def top_driver(driver_rows: DataFrame) -> DataFrame:
    """One row, if there are drivers: the greatest one in the direction of the whole change, the last of equals; else the first of all.

    Only the extremes are gathered, by aggregates; nothing is sorted.
    """
    key = F.array_join("key_values", "\x1f")
    each = F.struct("key_values", "delta", "contribution_pct")
    direction = driver_rows.agg(F.signum(F.sum("delta")).alias("way"))
    along = (F.col("way") != 0) & (F.signum("delta") == F.col("way"))
    # Of equal contributions the order by change, then key, decides: the last one is taken.
    most = F.max_by(each, F.when(along, F.struct(F.abs("contribution_pct"), -F.abs(F.col("delta")), key)))
    first = F.min_by(each, F.struct(-F.abs(F.col("delta")), key))
    row = driver_rows.crossJoin(F.broadcast(direction)).agg(F.coalesce(most, first).alias("d"))
    return row.where("d IS NOT NULL").select("d.*")


def issues(request: Request, driver_rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """(ord, code, message, segment) of everything that speaks against the answer."""
    tokens = T.tokens(F.lit(request.answer))
    named = mentions(segments(driver_rows), request.answer, request.weak_threshold)
    order = F.struct(-F.abs(F.col("contribution_pct")), "segment")
    amount, share = F.format_string("%+.2f", F.col("delta")), F.format_string("%+.1f%%", F.col("contribution_pct"))
    contradiction = F.concat("segment", F.lit(" went the other way: "), "actual_direction", F.lit(" ("), amount, F.lit("), claimed: "), "claimed_direction")
    weak = F.concat("segment", F.lit(" contributes little ("), share, F.lit(")"))
    each = named.select("segment", order.alias("o"), F.explode(F.array_compact(F.array(
        F.when(F.col("contradiction"), F.struct(F.lit(1).alias("k"), F.lit("CONTRADICTION").alias("code"), contradiction.alias("message"))),
        F.when(F.col("weak"), F.struct(F.lit(2).alias("k"), F.lit("WEAK_SIGNAL").alias("code"), weak.alias("message"))),
    ))).alias("i"))
    by_segment = each.select(F.struct(F.lit(1).alias("a"), F.col("o")[F.lit("col1")].alias("b"), F.col("segment").alias("c"), F.col("i.k").alias("d")).alias("ord"), "i.code", "i.message", "segment")
    at = lambda a: F.struct(F.lit(a).alias("a"), F.lit(0.0).alias("b"), F.lit("").alias("c"), F.lit(0).alias("d")).alias("ord")
    nothing = F.lit(None).cast("string").alias("segment")
    missing = top_driver(driver_rows).where(~F.exists("key_values", lambda v: T.mentions(tokens, v)))
    text = F.concat(F.lit("The main driver isn't named: "), F.array_join("key_values", " | "), F.lit(" ("), amount, F.lit(", "), share, F.lit(")"))
    lost = missing.select(at(2), F.lit("MISSING_DRIVER").alias("code"), text.alias("message"), nothing)
    silent = named.agg(F.count("*").alias("n")).where("n = 0").select(at(3), F.lit("NO_DATA_CLAIMS").alias("code"), F.lit("The answer names no segment of the data").alias("message"), nothing)
    bad = skipped.where("skipped > 0").select(at(4), F.lit("DATA_QUALITY").alias("code"), F.concat(F.col("skipped").cast("string"), F.lit(f" rows have a period that is no {request.granularity}")).alias("message"), nothing)
    return by_segment.unionByName(lost).unionByName(silent).unionByName(bad)


def verdict(issue_rows: DataFrame, driver_rows: DataFrame, answer: str) -> DataFrame:
    """One row: verdict, alignment score, confidence, and the share of the three main drivers that the answer names."""
    tokens = T.tokens(F.lit(answer))
    counts = issue_rows.agg(F.count("*").alias("n"), F.count_if(F.col("code") == "CONTRADICTION").alias("c"), F.count_if(F.col("code") == "MISSING_DRIVER").alias("m"), F.count_if(F.col("code") == "WEAK_SIGNAL").alias("w"))
    main = driver_rows.orderBy(F.desc(F.abs("delta")), F.array_join("key_values", "\x1f")).limit(3)
    covered = main.agg(F.coalesce(F.avg(F.exists("key_values", lambda v: T.mentions(tokens, v)).cast("int")) * 100, F.lit(0.0)).alias("coverage_pct"))
    wrong, some = (F.col("c") > 0) | (F.col("m") > 0), F.col("n") > 0
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.4 * F.col("c") - 0.3 * F.least(F.col("m"), F.lit(1)) - 0.1 * F.col("w")))
    pick = lambda a, b, c: F.when(wrong, a).when(some, b).otherwise(c)
    return counts.crossJoin(covered).select(pick("INCORRECT", "RISKY", "SUPPORTED").alias("verdict"), score.alias("alignment_score"), pick("HIGH", "MEDIUM", "LOW").alias("confidence"), "coverage_pct")


def audited(facts: DataFrame, request: Request) -> dict:
    """The whole report as a dictionary; only its own few rows leave the cluster."""
    found = drivers(facts, request.group_by, request.metric, request.period_col, request.baseline, request.current, request.granularity)
    found = materialize(found, "drivers")
    total = found.agg(F.sum("delta").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        raise AuditError(f"no rows of {request.baseline!r} or {request.current!r}")
    skipped = skipped_rows(facts, request.period_col, request.granularity)
    issue_rows = materialize(issues(request, found, skipped), "issues")
    named = mentions(segments(found), request.answer, request.weak_threshold).orderBy(F.desc(F.abs("contribution_pct")), "segment")
    result = verdict(issue_rows, found, request.answer).first().asDict()
    tops = found.orderBy(F.desc(F.abs("delta")), F.array_join("key_values", "\x1f")).limit(5).collect()
    report = {
        "verdict": result["verdict"], "question": request.question, "answer": request.answer, "baseline_period": request.baseline, "current_period": request.current, "total_delta": total["t"],
        "top_drivers": [{"label": " | ".join(r["key_values"]), **{k: r[k] for k in ("baseline", "current", "delta", "contribution_pct")}} for r in tops],
        "mentions": [{k: r[k] for k in ("segment", "claimed_direction", "actual_direction", "delta", "contribution_pct")} for r in named.collect()],
        "issues": [{"code": r["code"], "message": r["message"]} for r in issue_rows.orderBy("ord").collect()],
        "coverage_pct": result["coverage_pct"], "alignment_score": result["alignment_score"], "confidence": result["confidence"],
    }
    return report
