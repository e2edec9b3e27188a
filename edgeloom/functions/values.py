"""Integer values of an analysis, and set and map functions on neighbour arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column) -> Column:
    """Whole-number division, towards zero."""
    return F.call_function("div", a, b)


def floor_div(a: Column, b: Column) -> Column:
    """Division rounded down; null for a divisor of 0."""
    safe = F.when(b != 0, b)
    exact = div(a, safe)
    return exact - F.when((a % safe != 0) & ((a < 0) != (b < 0)), 1).otherwise(0)


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def set_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_proper_subset(a: Column, b: Column) -> Column:
    return is_subset(a, b) & (F.size(F.array_distinct(b)) > F.size(F.array_distinct(a)))


def insert(a: Column, x: Column) -> Column:
    return F.array_sort(F.array_union(a, F.array(x)))


def delete(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def split(a: Column, x: Column) -> Column:
    """Struct of the elements below x, whether x is there, and those above."""
    return F.struct(F.filter(a, lambda e: e < x).alias("below"), F.array_contains(a, x).alias("found"), F.filter(a, lambda e: e > x).alias("above"))


def fold(a: Column, zero: Column, step) -> Column:
    return F.aggregate(a, zero, step)


def map_from_set(keys: Column, value: Column) -> Column:
    return F.map_from_arrays(keys, F.array_repeat(value, F.size(keys)))


def map_union_with(a: Column, b: Column, step) -> Column:
    """Keys of either map; step(x, y) where both have one."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(step(x, y)))


def met(a: Column, b: Column) -> Column:
    """Entries (key, value: x, y) of the keys of either map, ascending; x or y is null where its map hasn't the key."""
    return entries(F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("x"), y.alias("y"))))


def map_intersection_with(a: Column, b: Column, step) -> Column:
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNotNull() & y.isNotNull(), step(x, y))), lambda k, v: v.isNotNull())


def map_difference(a: Column, b: Column) -> Column:
    # one pass over both maps: whether a key is in b is told by a value that isn't null
    both = F.map_zip_with(F.transform_values(a, lambda k, v: F.struct(v.alias("v"))), F.transform_values(b, lambda k, v: F.lit(True)), lambda k, x, y: F.when(y.isNull(), x))
    return F.transform_values(F.map_filter(both, lambda k, x: x.isNotNull()), lambda k, x: x["v"])


def map_adjust(a: Column, key: Column, step) -> Column:
    return F.transform_values(a, lambda k, v: F.when(k == key, step(v)).otherwise(v))


def map_insert_with(a: Column, key: Column, value: Column, step) -> Column:
    """step(new, old) where the key is there."""
    return map_union_with(a, F.create_map(key, value), lambda old, new: step(new, old))


def find_with_default(a: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(a, key), default)


def subtract_all(a: Column, keys: Column) -> Column:
    """A map without some keys."""
    return F.map_filter(a, lambda k, v: ~F.array_contains(keys, k))


def partition(a: Column, condition) -> Column:
    """Struct of the elements that meet a condition and of those that don't."""
    return F.struct(F.filter(a, condition).alias("yes"), F.filter(a, lambda e: ~condition(e)).alias("no"))


def min_view(a: Column) -> Column:
    """Struct of the smallest element and the others; null for an empty set."""
    return F.when(F.size(a) > 0, F.struct(F.array_min(a).alias("first"), F.array_remove(a, F.array_min(a)).alias("rest")))


def max_view(a: Column) -> Column:
    """Struct of the largest element and the others; null for an empty set."""
    return F.when(F.size(a) > 0, F.struct(F.array_max(a).alias("first"), F.array_remove(a, F.array_max(a)).alias("rest")))


def delete_min(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_remove(a, F.array_min(a))).otherwise(a)


def delete_max(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.array_remove(a, F.array_max(a))).otherwise(a)


def set_map(a: Column, step) -> Column:
    """The set of an element's images."""
    return F.array_sort(F.array_distinct(F.transform(a, step)))


def unions(sets: Column) -> Column:
    """The union of an array of sets."""
    return F.array_sort(F.array_distinct(F.flatten(sets)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: sets in ascending order of their elements, the first difference decides, a prefix comes first."""
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def show_set(a: Column) -> Column:
    """As text, in ascending order of the elements."""
    return F.concat(F.lit("fromList ["), F.array_join(F.transform(F.array_sort(a), lambda e: e.cast("string")), ","), F.lit("]"))


def show_map(a: Column) -> Column:
    """As text, in ascending order of the keys."""
    return F.concat(F.lit("fromList ["), F.array_join(F.transform(entries(a), lambda e: F.concat(F.lit("("), e["key"].cast("string"), F.lit(","), e["value"].cast("string"), F.lit(")"))), ","), F.lit("]"))


def entries(a: Column) -> Column:
    """A map's entries (key, value) in ascending order of the keys."""
    return F.sort_array(F.map_entries(a))


def _from(rows: Column) -> Column:
    return F.map_from_entries(rows)


def from_list(rows: Column) -> Column:
    """A map of an array of entries (key, value); of equal keys the last one stays."""
    latest = lambda e, i: ~F.exists(F.slice(rows, i + 2, F.size(rows)), lambda o: o["key"] == e["key"])
    return _from(F.filter(rows, latest))


def from_list_with(rows: Column, step) -> Column:
    """A map of an array of entries; step(new, old) where a key comes again."""
    keys = F.array_distinct(F.transform(rows, lambda e: e["key"]))

    def value(k: Column) -> Column:
        own = F.transform(F.filter(rows, lambda e: e["key"] == k), lambda e: e["value"])
        return F.aggregate(F.slice(own, F.lit(2), F.size(own)), F.get(own, F.lit(0)), lambda old, new: step(new, old))

    return F.map_from_arrays(keys, F.transform(keys, value))


def map_values(a: Column, step) -> Column:
    """step(key, value) as the new value of each key."""
    return F.transform_values(a, step)


def map_maybe(a: Column, step) -> Column:
    """step(key, value) as the new value; keys for which it is null go."""
    return F.map_filter(F.transform_values(a, step), lambda k, v: v.isNotNull())


def map_either(a: Column, condition, left, right) -> Column:
    """Struct of two maps: left(k, v) of the entries that meet the condition, right(k, v) of the others."""
    return F.struct(F.transform_values(F.map_filter(a, condition), left).alias("left"), F.transform_values(F.map_filter(a, lambda k, v: ~condition(k, v)), right).alias("right"))


def map_partition(a: Column, condition) -> Column:
    """Struct of the entries that meet a condition and of those that don't."""
    return F.struct(F.map_filter(a, condition).alias("yes"), F.map_filter(a, lambda k, v: ~condition(k, v)).alias("no"))


def split_lookup(a: Column, key: Column) -> Column:
    """Struct of the entries below a key, its value (null if it isn't there) and the entries above."""
    return F.struct(F.map_filter(a, lambda k, v: k < key).alias("below"), F.try_element_at(a, key).alias("found"), F.map_filter(a, lambda k, v: k > key).alias("above"))


def lookup(a: Column, key: Column) -> Column:
    """The key's value, null if it isn't there."""
    return F.try_element_at(a, key)


def map_insert(a: Column, key: Column, value: Column) -> Column:
    return map_insert_with(a, key, value, lambda new, old: new)


def insert_lookup_with(a: Column, key: Column, value: Column, step) -> Column:
    """Struct of the value that the key had, null if none, and the map with step(new, old)."""
    return F.struct(lookup(a, key).alias("old"), map_insert_with(a, key, value, step).alias("map"))


def map_delete(a: Column, key: Column) -> Column:
    return F.map_filter(a, lambda k, v: k != key)


def alter(a: Column, key: Column, step) -> Column:
    """step(value or null) as the key's new value; the key goes if that is null, and comes if it wasn't there."""
    new = step(lookup(a, key))
    rest = map_delete(a, key)
    return F.when(new.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, new)))


def update(a: Column, key: Column, step) -> Column:
    """step(value) as the new value of a key that is there; the key goes if that is null."""
    return F.map_filter(map_adjust(a, key, step), lambda k, v: v.isNotNull() | (k != key))


def update_lookup(a: Column, key: Column, step) -> Column:
    """Struct of the key's new value (the old one if the key goes, null if it wasn't there) and the map."""
    old = lookup(a, key)
    return F.struct(F.coalesce(step(old), old).alias("value"), update(a, key, step).alias("map"))


def map_difference_with(a: Column, b: Column, step) -> Column:
    """Entries of a; step(x, y) where b has the key too, which goes if that is null."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), None).when(y.isNull(), x).otherwise(step(x, y)))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def is_submap_by(a: Column, b: Column, same) -> Column:
    """Has b every key of a, with same(x, y)?"""
    return F.forall(F.map_entries(a), lambda e: F.coalesce(same(e["value"], F.try_element_at(b, e["key"])), F.lit(False)))


def is_submap(a: Column, b: Column) -> Column:
    return is_submap_by(a, b, lambda x, y: x == y)


def is_proper_submap(a: Column, b: Column) -> Column:
    return is_submap(a, b) & (F.size(b) > F.size(a))


def map_min_view(a: Column) -> Column:
    """Struct of the entry of the smallest key and the other entries; null for an empty map."""
    return F.when(F.size(a) > 0, F.struct(F.get(entries(a), F.lit(0)).alias("first"), _from(F.slice(entries(a), F.lit(2), F.size(a))).alias("rest")))


def map_max_view(a: Column) -> Column:
    """Struct of the entry of the largest key and the other entries; null for an empty map."""
    return F.when(F.size(a) > 0, F.struct(F.element_at(entries(a), -1).alias("first"), F.map_filter(a, lambda k, v: k != F.array_max(F.map_keys(a))).alias("rest")))


def map_accum(a: Column, zero: Column, step) -> Column:
    """Struct of the last state and the map of values: step(state, key, value) gives (state, value) in ascending order of the
    keys. Both are of the type of zero."""
    state = F.struct(zero.alias("state"), F.array().cast("array<bigint>").alias("values"))

    def go(acc: Column, e: Column) -> Column:
        new, value = step(acc["state"], e["key"], e["value"])
        return F.struct(new.alias("state"), F.concat(acc["values"], F.array(value)).alias("values"))

    done = F.aggregate(entries(a), state, go)
    return F.struct(done["state"].alias("state"), F.map_from_arrays(F.transform(entries(a), lambda e: e["key"]), done["values"]).alias("map"))


def map_fold(a: Column, zero: Column, step) -> Column:
    """step(state, key, value), in ascending order of the keys."""
    return F.aggregate(entries(a), zero, lambda acc, e: step(acc, e["key"], e["value"]))


def keys_set(a: Column) -> Column:
    return F.array_sort(F.map_keys(a))


def unions_with(maps: Column, step) -> Column:
    """The union of an array of maps; step(x, y) for equal keys, from the first map on."""
    return F.aggregate(F.slice(maps, F.lit(2), F.size(maps)), F.get(maps, F.lit(0)), lambda acc, m: map_union_with(acc, m, step))


def union_with_set_value(a: Column, keys: Column, value: Column, step) -> Column:
    """A map and a set of which each element has one value: step(value in the map, value) for keys of both."""
    return map_union_with(a, map_from_set(keys, value), step)
