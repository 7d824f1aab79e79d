"""Repeatable data faults for testing cleaning rules.

A row is hit when the md5 bucket of ``salt|key`` falls below the rate, so the same rows are hit on every
run and no row order is needed. Every injector returns the changed table and a manifest of the changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import NULL_TOKENS, hash_bucket, rnd
from stallkeeper.operators.clean import ORPHAN_PREFIX, ZOMBIE_ID_PREFIX

HASH_RANGE = 1 << 28
MANIFEST_COLUMNS = (
    "chaos_type", "table", "original_row_id", "new_row_id", "column_affected", "original_value", "new_value",
    "description",
)

# fixed values: artefacts the faults leave behind
CURRENCY_PREFIXES = ("$", "USD ", "€", "R$", "")
ZOMBIE_NAMES = (
    "TEST USER", "test test", "ASDF ASDF", "John Doe", "Jane Smith", "QA Test", "DELETE ME", "xxxxx",
    "Sample Customer", "Fake Person", "DO NOT USE",
)
ZOMBIE_EMAILS = (
    "test@test.com", "admin@localhost", "asdf@asdf.com", "noreply@example.com", "test123@test.com",
    "qa@internal.co", "delete.me@fake.com",
)
PROMO_CODES = ("SUMMER20", "WELCOME10", "FLASH30", "VIP50", "HOLIDAY25", "NEWUSER", None)

Faulty = tuple[DataFrame, DataFrame]


def hit(salt: str, key: str, rate: float) -> Column:
    return hash_bucket(salt, F.col(key)) < F.lit(int(rate * HASH_RANGE))


def choose(options: Sequence[str | None], salt: str, key: str) -> Column:
    values = F.array(*[F.lit(o) for o in options])
    return F.element_at(values, (hash_bucket(salt, F.col(key)) % len(options)).cast("int") + 1)


def _digest(salt: str, key: str, length: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(salt + "|"), F.col(key))), 1, length)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _log(rows: DataFrame, **columns: Column | str) -> DataFrame:
    blank = {c: F.lit("") for c in MANIFEST_COLUMNS}
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    merged = {**blank, **given}
    return rows.select(*[merged[c].alias(c) for c in MANIFEST_COLUMNS])


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def inject_duplicates(
    df: DataFrame, rate: float, id_col: str, ts_cols: Sequence[str], salt: str, drift_seconds: int = 5,
    modify_id: bool = True,
) -> Faulty:
    copies = df.where(hit(salt, id_col, rate))
    new_id = F.md5(F.concat(F.lit(salt + "|"), F.col(id_col))) if modify_id else F.col(id_col)
    moved = {
        c: F.col(c) + F.make_dt_interval(secs=hash_bucket(f"{salt}-{c}", F.col(id_col)) % drift_seconds + 1)
        for c in ts_cols
    }
    log = _log(
        copies, chaos_type="duplicate", original_row_id=F.col(id_col), new_row_id=new_id, column_affected=id_col,
        original_value=F.col(id_col), new_value=new_id,
        description=f"copy with up to {drift_seconds}s time drift",
    )
    return df.unionByName(copies.withColumns({**moved, id_col: new_id})), log


def _replace_cells(df: DataFrame, key: str, kind: str, changes: Mapping[str, tuple[Column, Column]]) -> Faulty:
    """Apply ``column -> (where, new value)`` and log every changed cell."""
    logs = [
        _log(
            df.where(where), chaos_type=kind, original_row_id=F.col(key), column_affected=c,
            original_value=_text(F.col(c)), new_value=_text(new), description=f"{kind} in {c}",
        )
        for c, (where, new) in changes.items()
    ]
    dirty = df.withColumns({c: F.when(where, new).otherwise(F.col(c)) for c, (where, new) in changes.items()})
    return dirty, _stack(logs)


def inject_null_tokens(
    df: DataFrame, rate: float, key: str, cols: Sequence[str], salt: str, tokens: Sequence[str] = NULL_TOKENS
) -> Faulty:
    changes = {c: (hit(f"{salt}-{c}", key, rate), choose(tokens, f"{salt}-{c}-token", key)) for c in cols}
    return _replace_cells(df, key, "null_representation", changes)


def inject_type_drift(
    df: DataFrame, rate: float, key: str, cols: Sequence[str], salt: str, prefixes: Sequence[str] = CURRENCY_PREFIXES
) -> Faulty:
    """Numbers become text; a missing number becomes the word ``None``."""
    changes = {}
    numbers = df
    for c in cols:
        raw = F.col(f"_num_{c}")
        numbers = numbers.withColumn(f"_num_{c}", F.col(c)).withColumn(c, _text(F.col(c)))
        text = F.col(c)
        kind = hash_bucket(f"{salt}-{c}-kind", F.col(key)) % 4
        drifted = (
            F.when(kind == 0, F.concat(choose(prefixes, f"{salt}-{c}-prefix", key), text))
            .when(kind == 1, F.replace(text, F.lit("."), F.lit(",")))
            .when(kind == 2, F.concat(F.lit("  "), text, F.lit("  ")))
            .otherwise(F.when(raw > 1000, F.format_number(raw, 2)).otherwise(text))
        )
        changes[c] = (hit(f"{salt}-{c}", key, rate), drifted)
    dirty, log = _replace_cells(numbers, key, "type_drift", changes)
    return dirty.drop(*[f"_num_{c}" for c in cols]), log


def garble(text: Column) -> Column:
    """UTF-8 bytes read as Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def inject_mojibake(df: DataFrame, rate: float, key: str, cols: Sequence[str], salt: str) -> Faulty:
    changes = {c: (hit(f"{salt}-{c}", key, rate) & (garble(F.col(c)) != F.col(c)), garble(F.col(c))) for c in cols}
    return _replace_cells(df, key, "encoding", changes)


def inject_late(
    df: DataFrame, rate: float, key: str, date_col: str, salt: str, max_days: int = 90, min_days: int = 7,
    out: str = "_ingestion_delay_days",
) -> Faulty:
    delay = hash_bucket(f"{salt}-days", F.col(key)) % (max_days - min_days + 1) + min_days
    late = hit(salt, key, rate)
    log = _log(
        df.where(late), chaos_type="late_arrival", original_row_id=F.col(key), column_affected=date_col,
        new_value=F.concat(F.lit("+"), delay.cast("string"), F.lit(" days")), description="record arrived late",
    )
    return df.withColumn(out, F.when(late, delay).otherwise(F.lit(0)).cast("int")), log


def inject_orphans(df: DataFrame, rate: float, key: str, fk: str, salt: str) -> Faulty:
    fake = F.concat(F.lit(ORPHAN_PREFIX), _digest(salt, key, 12))
    return _replace_cells(df, key, "orphan_record", {fk: (hit(salt, key, rate), fake)})


@dataclass(frozen=True)
class Violation:
    """``negative`` needs the size range in steps of ``step``; ``exceeds`` needs the column to exceed."""

    column: str
    kind: str
    low: int = 1
    high: int = 100
    step: float = 1.0
    ref: str | None = None


def inject_violations(df: DataFrame, rate: float, key: str, specs: Sequence[Violation], salt: str) -> Faulty:
    changes = {}
    for s in specs:
        bucket = hash_bucket(f"{salt}-{s.column}-size", F.col(key))
        if s.kind == "negative":
            size = bucket % (s.high - s.low + 1) + s.low
            value = -size if s.step == 1.0 else -(size / F.lit(1.0 / s.step))
        elif s.kind == "zero":
            value = F.lit(0)
        elif s.kind == "exceeds" and s.ref:
            value = rnd(F.col(s.ref) * (F.lit(1.5) + (bucket % 1501) / F.lit(1000.0)))
        else:
            raise ValueError(f"unknown violation {s}")
        target = df.schema[s.column].dataType
        changes[s.column] = (hit(f"{salt}-{s.column}", key, rate / len(specs)), value.cast(target))
    return _replace_cells(df, key, "business_logic_violation", changes)


def inject_zombies(df: DataFrame, count: int, id_col: str, cols: Sequence[str], salt: str) -> Faulty:
    digest = F.md5(F.concat(F.lit(salt + "|"), F.col(id_col)))
    templates = df.orderBy(digest, id_col).limit(count)
    fakes = {
        c: choose(ZOMBIE_EMAILS if "email" in c else ZOMBIE_NAMES, f"{salt}-{c}", id_col) for c in cols
    }
    new_id = F.concat(F.lit(ZOMBIE_ID_PREFIX), F.substring(digest, 1, 8))
    zombies = templates.withColumns({**fakes, id_col: new_id})
    log = _log(
        zombies, chaos_type="zombie_test_data", original_row_id="N/A", new_row_id=F.col(id_col),
        column_affected="multiple", original_value="N/A", new_value="test/QA record",
        description="test record with fake personal data",
    )
    return df.unionByName(zombies), log


def inject_schema_evolution(
    df: DataFrame, key: str, add: Sequence[str], rename: Mapping[str, str], salt: str, absent: float = 0.4,
    fill: float = 0.3,
) -> Faulty:
    """Columns that exist only for part of the rows, and renamed columns."""
    new = {}
    for c in add:
        if "promo" in c:
            value = choose(PROMO_CODES, f"{salt}-{c}-value", key)
        elif "points" in c:
            value = (hash_bucket(f"{salt}-{c}-value", F.col(key)) % 5001).cast("string")
        else:
            value = F.concat(F.lit("ref_"), (hash_bucket(f"{salt}-{c}-value", F.col(key)) % 9000 + 1000).cast("string"))
        new[c] = F.when(~hit(f"{salt}-era", key, absent) & hit(f"{salt}-{c}", key, fill), value)
    out = df.withColumns(new)
    for old, name in rename.items():
        out = out.withColumnRenamed(old, name)
    one = df.sparkSession.range(1)
    logs = [
        _log(one, chaos_type="schema_evolution", original_row_id="N/A", new_row_id="N/A", column_affected=c,
             original_value="column_did_not_exist", new_value="column_added", description=f"{c} added mid-stream")
        for c in add
    ] + [
        _log(one, chaos_type="schema_evolution", original_row_id="N/A", new_row_id="N/A", column_affected=old,
             original_value=old, new_value=name, description=f"{old} renamed")
        for old, name in rename.items()
    ]
    return out, _stack(logs)


@dataclass(frozen=True)
class FaultPlan:
    """Rates of the faults applied to a whole marketplace."""

    duplicates: float = 0.03
    nulls: float = 0.08
    drift: float = 0.05
    encoding: float = 0.04
    late: float = 0.02
    orphans: float = 0.01
    violations: float = 0.02
    zombies: int = 50
    added: tuple[str, ...] = ("promo_code", "loyalty_points", "referral_source")
    renamed: Mapping[str, str] = field(default_factory=lambda: {"customer_external_id": "cust_ext_id"})


DIRTY_TABLES = ("customers", "orders", "order_items", "payments", "shipments", "reviews")


def dirty_table(name: str, df: DataFrame, plan: FaultPlan | None = None) -> Faulty:
    """A faulty copy of one table with its manifest."""
    p = plan or FaultPlan()
    steps = {
        "customers": [
            lambda d: inject_duplicates(d, p.duplicates, "customer_id", ["created_at", "updated_at"], "c-dup"),
            lambda d: inject_null_tokens(
                d, p.nulls, "customer_id", ["email", "first_name", "last_name", "signup_channel"], "c-null"),
            lambda d: inject_mojibake(d, p.encoding, "customer_id", ["first_name", "last_name", "email"], "c-enc"),
            lambda d: inject_zombies(d, p.zombies, "customer_id", ["email", "first_name", "last_name"], "c-zom"),
            lambda d: inject_schema_evolution(d, "customer_id", p.added, p.renamed, "c-evo"),
        ],
        "orders": [
            lambda d: inject_duplicates(
                d, p.duplicates, "order_id", ["order_placed_at", "created_at", "updated_at"], "o-dup"),
            lambda d: inject_null_tokens(d, p.nulls, "order_id", ["order_number", "currency"], "o-null"),
            lambda d: inject_violations(d, p.violations, "order_id", [
                Violation("shipping_cost", "negative", 1, 2000, 0.01),
                Violation("discount_amount", "exceeds", ref="subtotal"),
            ], "o-vio"),
            lambda d: inject_type_drift(
                d, p.drift, "order_id", ["total_amount", "subtotal", "discount_amount", "shipping_cost"], "o-drift"),
            lambda d: inject_late(d, p.late, "order_id", "order_placed_at", "o-late"),
        ],
        "order_items": [
            lambda d: inject_orphans(d, p.orphans, "order_item_id", "order_id", "i-orph"),
            lambda d: inject_violations(d, p.violations, "order_item_id", [Violation("quantity", "negative", 1, 5)], "i-vio"),
            lambda d: inject_type_drift(
                d, p.drift, "order_item_id", ["unit_price", "unit_cost", "line_total"], "i-drift"),
        ],
        "payments": [
            # retries make duplicates twice as likely here
            lambda d: inject_duplicates(d, p.duplicates * 2, "payment_id", ["attempted_at", "created_at"], "p-dup", 3),
            lambda d: inject_null_tokens(d, p.nulls, "payment_id", ["card_brand", "failure_reason"], "p-null"),
            lambda d: inject_orphans(d, p.orphans, "payment_id", "order_id", "p-orph"),
        ],
        "shipments": [
            lambda d: inject_duplicates(d, p.duplicates, "shipment_id", ["shipped_at", "created_at"], "s-dup"),
            lambda d: inject_null_tokens(d, p.nulls, "shipment_id", ["tracking_number", "carrier"], "s-null"),
        ],
        "reviews": [
            lambda d: inject_mojibake(d, p.encoding, "review_id", ["title", "review_text"], "r-enc"),
            lambda d: inject_orphans(d, p.orphans, "review_id", "product_id", "r-orph"),
        ],
    }
    logs = []
    for step in steps[name]:
        df, log = step(df)
        logs.append(log)
    return df, _stack(logs).withColumn("table", F.lit(name))


def dirty_marketplace(tables: Mapping[str, DataFrame], plan: FaultPlan | None = None) -> dict[str, Faulty]:
    """Faulty copies of six tables; the other tables stay clean."""
    return {name: dirty_table(name, tables[name], plan) for name in DIRTY_TABLES}


def manifest(faulty: Mapping[str, Faulty]) -> DataFrame:
    return _stack([log for _, log in faulty.values()])


def cleaning_recall(cleaned: DataFrame, log: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per fault and column: damaged cells, cells whose row survived cleaning, cells back to their old value.

    Numbers compare as text of doubles. A null token counts as handled when the cleaned cell is NULL.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    long = cleaned.select(F.col(key).alias("original_row_id"), F.inline(cells)).withColumnRenamed("c", "column_affected")
    damaged = log.where(F.col("column_affected").isin(list(columns)) & (F.col("original_row_id") != ""))
    joined = damaged.join(long.withColumn("_kept", F.lit(True)), ["original_row_id", "column_affected"], "left")
    as_null = F.col("chaos_type") == "null_representation"
    good = F.when(as_null, F.col("v").isNull()).otherwise(_text(F.col("v")) == F.col("original_value"))
    kept = F.coalesce("_kept", F.lit(False))
    return joined.groupBy("chaos_type", "column_affected").agg(
        F.count("*").alias("damaged"),
        F.count_if(kept).alias("kept"),
        F.count_if(kept & F.coalesce(good, F.lit(False))).alias("restored"),
    )
