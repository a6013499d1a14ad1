"""Best representative of each group of duplicates: votes elect the record that is kept and every field of a built one.

Fields are unpivoted to long rows (group, field, candidate). A filled value votes for
its normalised form with its source's trust times a decay by age, and for the record
it stands in with one vote. Votes for the same candidate add up; the winner of each
field is taken by max_by and the fields are pivoted back. All aggregates are
algebraic, so a group with a third of all rows is folded on the map side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: letters, number of three digits or more, leading zeros counted, version; what joins them is free, but for a path separator.
ACCESSION = r"(?i)(?<![a-z0-9])([a-z]+)[^a-z0-9/]*(?=[0-9]{3})0*([1-9][0-9]*|0)(?:v|[^a-z0-9/])0*([0-9]+)(?![0-9])"
#: Texts that stand for a missing value (fixed values of the test data).
STAND_INS = ["", "-", "--", "na", "n/a", "nan", "nil", "none", "null", "unknown", "undefined", "?", "."]
#: The election of the kept record, beside those of the fields.
RECORD = "__record"
#: Day of an undated vote: before all dated ones, so that it counts only among its like.
UNDATED_DAY = -100_000


def is_stand_in(c: str | Column) -> Column:
    """Null, blank, or one of the texts written for a missing value."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")).isin(STAND_INS)


def accession_in(text: Column) -> Column:
    """``letters_number.version`` in lower case without leading zeros, or null if the text has none."""
    t = F.regexp_replace(text, "(?i)%5f", "_")
    part = [F.regexp_extract(t, ACCESSION, i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.concat(F.lower(part[0]), F.lit("_"), part[1], F.lit("."), part[2]))


def accession(file_name: str, headers: str) -> Column:
    """The accession in the file name, else the first one in the contig headers."""
    found = F.filter(F.transform(F.col(headers), accession_in), lambda x: x.isNotNull())
    return F.coalesce(accession_in(F.col(file_name)), F.try_element_at(found, F.lit(1)))


def ballots(df: DataFrame, group: Sequence[str], id: str, fields: Mapping[str, tuple[Column, Column]], trust: Column, recency: Column, half_life_days: float) -> DataFrame:
    """``(*group, field, norm, vote, from_field, trust, at, id, value)``: the unpivoted votes of all filled fields.

    The weight of a value is trust * 2 ** (day / half life), days being counted from
    1970: only ratios of weights matter, so no day has to be taken for today and later
    days need no new scale. Trust below 0.1 counts as 0.1.
    """
    day = F.coalesce(F.datediff(recency.cast("date"), F.lit("1970-01-01").cast("date")), F.lit(UNDATED_DAY))
    weight = F.greatest(F.coalesce(trust, F.lit(0)).cast("double"), F.lit(0.1)) * F.pow(F.lit(2.0), day / F.lit(float(half_life_days)))

    def cell(field: str, filled: Column, norm: Column, vote: Column, from_field: int, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), filled.alias("filled"), norm.cast("string").alias("norm"), vote.alias("vote"), F.lit(from_field).cast("long").alias("from_field"), value.alias("value"))

    cells = [cell(n, fill, norm, weight, 0, F.to_json(F.struct(F.col(n).alias("v")))) for n, (fill, norm) in fields.items()]
    # A record runs even if nothing in it is filled, with no vote.
    none = F.lit(None).cast("string")
    cells += [cell(RECORD, fill, F.col(id), F.lit(1.0), 1 << i, none) for i, (fill, _) in enumerate(fields.values())] + [cell(RECORD, F.lit(True), F.col(id), F.lit(0.0), 0, none)]
    rows = df.filter(F.col(group[0]).isNotNull() & F.col(id).isNotNull())
    rows = rows.select(*group, F.coalesce(trust, F.lit(0)).cast("double").alias("trust"), recency.alias("at"), F.col(id).alias("id"), F.explode(F.array(*cells)).alias("c"))
    return rows.select(*group, "trust", "at", "id", "c.*").filter("filled").drop("filled")


def elected_records(df: DataFrame, group: Sequence[str], id: str, fields: Mapping[str, tuple[Column, Column]], trust: Column, recency: Column, *, half_life_days: float = 180.0) -> DataFrame:
    """``(*group, keep_id, n_records, *fields)``: one row per group with the kept record and the winning value of every field.

    fields: name -> (is it filled, its normalised form).
    keep_id: the record with most votes, one from each of its filled fields; equal
        votes: the higher trust (null counts as 0), then the later record (null is
        oldest), then the smaller id.
    A field's value: that of the normalised form with most votes, as the latest record
        (then the one of smallest id) writes it; equal votes (to nine decimals of their
        binary logarithm, as sums depend on their order): the later, then the larger
        form. A field that no record fills is null.
    Rows whose first group column or id is null belong to no group; null values of the
    other group columns are equal. Rows that repeat an id are one record, for which a
    field votes once; for values each row votes. Empty input gives no rows.
    """
    types = {f.name: f.dataType for f in df.schema}
    long = ballots(df, group, id, fields, trust, recency, half_life_days)
    votes = long.groupBy(*group, "field", "norm").agg(F.sum("vote").alias("vote"), F.bit_count(F.bit_or("from_field")).cast("double").alias("fields"), F.max("trust").alias("trust"), F.max("at").alias("at"), F.min("id").alias("id"), F.max_by("value", F.struct("at", -F.col("id"))).alias("value"))
    record = F.col("field") == RECORD
    votes = votes.withColumn("rank", F.struct(F.when(record, F.col("fields")).otherwise(F.round(F.log2("vote"), 9)), F.when(record, F.col("trust")), "at", F.when(record, -F.col("id")), "norm"))
    best = votes.groupBy(*group, "field").agg(F.max_by(F.when(record, F.col("id").cast("string")).otherwise(F.col("value")), "rank").alias("value"), F.count(F.lit(1)).alias("n"))
    wide = best.groupBy(*group).pivot("field", [RECORD, *fields]).agg(F.first("value").alias("value"), F.first("n").alias("n"))
    made = [F.from_json(f"{n}_value", f"v {types[n].simpleString()}")["v"].alias(n) for n in fields]
    return wide.select(*group, F.col(f"{RECORD}_value").cast(types[id]).alias("keep_id"), F.col(f"{RECORD}_n").alias("n_records"), *made)
