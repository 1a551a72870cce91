"""A closed language of plain sentences over one table; nothing that is typed is ever evaluated.

    summarize income and pop                mean of income by county
    tabulate segment                        histogram of income
    correlate income with pop               regress income on pop and minority [robust]
    keep if income is at least 1,000        drop if pop is over 500
    keep valid data only                    top 10 by pop
    poisson | logit | negative binomial y on x and z [robust | clustered by county]
    spatial lag | spatial error y on x and z, with the contiguity of the areas (column id)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import regressions, stats

#: How a comparison may be worded, longest first.
_COMPARE = (
    ("is greater than or equal to", ">="), ("is less than or equal to", "<="), ("is no more than", "<="), ("is no less than", ">="), ("is greater than", ">"), ("is more than", ">"), ("is less than", "<"),
    ("is at least", ">="), ("is at most", "<="), ("is not", "!="), ("is over", ">"), ("is above", ">"), ("is under", "<"), ("is below", "<"), ("at least", ">="), ("at most", "<="), ("over", ">"), ("under", "<"),
    ("equals", "=="), ("is", "=="), (">=", ">="), ("<=", "<="), ("!=", "!="), ("==", "=="), (">", ">"), ("<", "<"), ("=", "=="),
)


@dataclass
class Result:
    data: DataFrame
    steps: list[tuple[str, bool, str]] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)


class _Unknown(ValueError):
    pass


def _variable(name: str, df: DataFrame, labels: dict[str, str]) -> str:
    plain = name.strip().lower()
    for c in df.columns:
        if plain in (c.lower(), c.lower().replace("_", " "), labels.get(c, "").lower()):
            return c
    raise _Unknown(f"no variable named {name.strip()}")


def _variables(text: str, df: DataFrame, labels: dict[str, str]) -> list[str]:
    return [_variable(p, df, labels) for p in re.split(r",|\band\b|\bwith\b", text) if p.strip()]


def condition(text: str, df: DataFrame, labels: dict[str, str] | None = None) -> Column:
    """A condition such as "income is at least 1,000 and pop over 5"."""
    out = None
    for part in re.split(r"\band\b", text):
        for words, op in _COMPARE:
            m = re.fullmatch(rf"\s*(.+?)\s*(?:\b{re.escape(words)}\b|{re.escape(words) if not words[0].isalpha() else '(?!)'})\s*(.+?)\s*", part, re.I)
            if m:
                name, raw = m[1], m[2].strip("\"'")
                c = F.col(_variable(name, df, labels or {}))
                number = raw.replace(",", "")
                value = F.lit(float(number)) if re.fullmatch(r"-?\d+(\.\d+)?", number) else F.lit(raw)
                one = {">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value, "==": c == value, "!=": c != value}[op]
                out = one if out is None else out & one
                break
        else:
            raise _Unknown(f"not a condition: {part.strip()}")
    return out


def run(df: DataFrame, text: str, labels: dict[str, str] | None = None, edges: DataFrame | None = None) -> Result:
    """Carry out the lines of a text; a line with an error is reported and the next ones go on.

    Spatial models need edges (i, j) of the areas, which df names in a column id.
    """
    labels, r = labels or {}, Result(df)
    spark = df.sparkSession
    for line in filter(None, (x.strip().rstrip(".") for x in text.splitlines())):
        try:
            out = _line(spark, r, line, labels, edges)
            if out is not None:
                r.tables.append(out)
            r.steps.append((line, True, ""))
        except _Unknown as e:
            r.steps.append((line, False, str(e)))
    return r


def _line(spark, r: Result, line: str, labels, edges=None) -> DataFrame | None:
    df, m = r.data, None

    def matches(pattern):
        nonlocal m
        m = re.fullmatch(pattern, line, re.I)
        return m

    if matches(r"keep (?:only )?valid data(?: only)?"):
        r.data = df.dropna()
    elif matches(r"(keep|drop) (?:if|where) (.+)"):
        c = condition(m[2], df, labels)
        r.data = df.where(c if m[1].lower() == "keep" else ~F.coalesce(c, F.lit(False)))
    elif matches(r"summari[sz]e (.+)"):
        parts = [F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in _variables(m[1], df, labels)]
        return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    elif matches(r"(?:mean|average) of (.+?) by (.+)"):
        x, g = _variable(m[1], df, labels), _variable(m[2], df, labels)
        return df.groupBy(g).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
    elif matches(r"tabulate (.+)"):
        g = _variable(m[1], df, labels)
        return df.groupBy(g).agg(F.count(F.lit(1)).alias("n"))
    elif matches(r"correlate (.+)"):
        cs = _variables(m[1], df, labels)
        pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for i, a in enumerate(cs) for b in cs[i + 1 :]]
        return df.dropna(subset=cs).agg(F.array(*pairs).alias("a")).select(F.inline("a"))
    elif matches(r"histogram of (.+)"):
        c = _variable(m[1], df, labels)
        span = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
        bin_ = F.least(F.lit(9), F.floor((F.col(c) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 10))
        return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(span)).groupBy(F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    elif matches(r"spatial (lag|error|regression) (?:of )?(.+?) on (.+)"):
        if edges is None or "id" not in df.columns:
            raise _Unknown("spatial models need areas with an id and their edges")
        y, xs = _variable(m[2], df, labels), _variables(m[3], df, labels)
        fit = regressions.spatial_error if m[1].lower() == "error" else regressions.spatial_lag
        return spark.createDataFrame(fit(df, y, xs, edges))
    elif matches(r"(regress|poisson|logit|negative binomial) (?:of )?(.+?) on (.+?)(?:,? (robust)|,? clustered by (.+))?"):
        y, xs = _variable(m[2], df, labels), _variables(m[3], df, labels)
        family = {"regress": "gaussian", "logit": "binomial"}.get(m[1].lower(), m[1].lower())
        if m[5] or family == "negative binomial" or m[4] and family != "gaussian":
            fit = regressions.fitted(df, y, xs, family, cluster=_variable(m[5], df, labels) if m[5] else None, robust=bool(m[4]))
            return spark.createDataFrame(fit.drop(columns=[] if m[5] else ["clusters"]))
        if family == "gaussian":
            return spark.createDataFrame(stats.least_squares(df, y, xs, bool(m[4])))
        return spark.createDataFrame(stats.generalised(df, y, xs, family)[0])
    elif matches(r"top (\d+) by (.+)"):
        c = _variable(m[2], df, labels)
        return df.where(F.col(c).isNotNull()).orderBy(F.desc(c)).limit(int(m[1]))
    else:
        raise _Unknown("not a command")
    return None
