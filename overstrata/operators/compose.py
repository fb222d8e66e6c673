"""Composition of records field by field, as expressions over ordered arrays of (signature, payload).

The result starts from the destination's fields; rules apply in order, and fields without a rule stay the destination's.
Flags, version and last change set are the source's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import codec
from ..functions import columns as K
from ..model import PackageError

REPLACE, KEEP, APPEND, APPEND_LIST = "replace", "keep_destination", "append_occurrences", "append_encoded_list"


@dataclass(frozen=True)
class Rule:
    """What happens to the fields of a signature. deduplicate goes with append_occurrences, mode with append_encoded_list."""

    signature: bytes | str
    strategy: str
    deduplicate: bool = False
    mode: str = "all"


def _is(sig):
    return lambda x: x["signature"] == F.lit(sig)


def replace(dst: Column, src: Column, sig: bytes | str) -> Column:
    """The source's occurrences stand where the first of the destination's was, or at the end; none of them deletes the field."""
    at = F.array_position(F.transform(dst, lambda x: x["signature"]), F.lit(sig)).cast("int")
    none = at == 0
    before = F.when(none, dst).otherwise(F.slice(dst, 1, F.greatest(at - 1, F.lit(0))))
    after = F.when(none, F.slice(dst, 1, 0)).otherwise(F.filter(F.slice(dst, F.greatest(at, F.lit(1)), F.size(dst)), lambda x: x["signature"] != F.lit(sig)))
    return F.concat(before, F.filter(src, _is(sig)), after)


def append(dst: Column, src: Column, sig: bytes | str, deduplicate: bool = False) -> Column:
    """The source's occurrences at the end of the record; with deduplicate only those it doesn't hold yet."""
    more = F.filter(src, _is(sig))
    return F.concat(dst, F.array_except(more, dst) if deduplicate else more)


def append_list(dst: Column, src: Column, sig: bytes | str, mode: str, limits: codec.Limits = codec.Limits()) -> Column:
    """Encoded lists joined. Absent in the source: unchanged; absent in the destination: the source's bytes as they are."""
    join = {"all": K.append_all, "new_indices": K.append_new_indices, "unique": K.append_unique}[mode]
    one = lambda x: K.decode_list(F.get(x, F.lit(0))["payload"], limits)

    def put(dst: Column, mine: Column, theirs: Column) -> Column:
        both = K.let(one(mine), lambda d: K.let(one(theirs), lambda s: K.encode_list(join(d, s), limits)))
        payload = lambda x: F.when(_is(sig)(x), both).otherwise(x["payload"])  # noqa: E731  there is one such field
        all_ = F.transform(dst, lambda x: F.struct(x["signature"].alias("signature"), payload(x).alias("payload")))
        many = F.raise_error(F.lit("ListSubrecordMultiplicity"))
        return F.when((F.size(mine) > 1) | (F.size(theirs) > 1), many).when(F.size(theirs) == 0, dst).when(F.size(mine) == 0, F.concat(dst, theirs)).otherwise(all_)

    own = lambda x, use: K.let(F.filter(x, _is(sig)), use)
    return K.let(dst, lambda d: own(d, lambda mine: own(src, lambda theirs: put(d, mine, theirs))))


def apply(dst: Column, src: Column, rules: Sequence[Rule]) -> Column:
    def one(acc: Column, r: Rule) -> Column:
        if r.strategy == KEEP:
            return acc
        if r.strategy == REPLACE:
            return replace(acc, src, r.signature)
        if r.strategy == APPEND:
            return append(acc, src, r.signature, r.deduplicate)
        if r.strategy == APPEND_LIST:
            return append_list(acc, src, r.signature, r.mode)
        raise PackageError("UnknownCompositionStrategy", strategy=r.strategy)

    return reduce(one, rules, dst)


def same_signature(fields: Column, *signatures: Column) -> Column:
    """fields, or an error if signatures of the records differ."""
    equal = reduce(lambda a, b: a & b, (signatures[0].eqNullSafe(s) for s in signatures[1:]), F.lit(True))
    return F.when(equal, fields).otherwise(F.raise_error(F.lit("OverrideSignatureMismatch")))


def compose_override(pairs: DataFrame, rules: Sequence[Rule], dst: str = "dst_fields", src: str = "src_fields", out: str = "fields", signatures: tuple[str, str] | None = None) -> DataFrame:
    """pairs with the composed fields of each. Each rule is a projection of its own, so expressions stay small.

    signatures: the columns of both records' signatures, which must be equal.
    """
    now = pairs.withColumn(out, same_signature(F.col(dst), *map(F.col, signatures)) if signatures else F.col(dst))
    for r in rules:
        now = now.withColumn(out, apply(F.col(out), F.col(src), [r]))
    return now


def compose_chain(chains: DataFrame, rules: Sequence[Rule], chain: str = "chain") -> DataFrame:
    """The fold of each chain (structs with ``fields``, and ``signature`` if records may differ in it) from its origin to its winner."""
    if "signature" in chains.schema[chain].dataType.elementType.names:
        different = F.size(F.array_distinct(F.transform(F.col(chain), lambda x: x["signature"]))) > 1
        chains = chains.withColumn(chain, F.when(different, F.raise_error(F.lit("OverrideSignatureMismatch"))).otherwise(F.col(chain)))
    fields = F.transform(F.col(chain), lambda x: x["fields"])
    kind = chains.schema[chain].dataType.elementType["fields"].dataType.simpleString()
    first = F.when(F.size(fields) > 0, F.get(fields, F.lit(0))).otherwise(F.raise_error(F.lit("EmptyOverrideChain")).cast(kind))
    return chains.withColumn("fields", F.aggregate(F.slice(fields, 2, F.size(fields)), first, lambda acc, x: apply(acc, x, rules)))


def digest(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """rows (signature, flags, record_id, version_raw, fields) with payload and digest."""
    return rows.withColumn("payload", K.encode_fields(fields)).withColumn("digest", K.record_digest("signature", "payload", "flags", "record_id", "version_raw"))
