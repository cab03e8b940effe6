"""Cross-table correlation: references, closure, symmetry, overlap, containment, overlays.

Joins carry no broadcast hints. The planner broadcasts a side only when its measured size allows,
and adaptive execution splits the tasks of a hot key otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardry.contracts import violations
from stewardry.functions.network import ip_parts, ip_to_long, network_parts
from stewardry.scale import block_of, cut, dealt


def cross_key(
    df: DataFrame,
    key: Column,
    targets: DataFrame,
    target_key: Column,
    *,
    policy: str,
    kind: str,
    object_id,
    **contract,
) -> DataFrame:
    """Rows whose normalised key matches no normalised target key; empty keys are skipped."""
    keyed = df.withColumn("_key", key).where(F.col("_key").isNotNull() & (F.col("_key") != ""))
    known = targets.select(target_key.alias("_key")).distinct()
    bad = keyed.join(known, "_key", "left_anti")
    reason = F.concat(F.col("_key"), F.lit(" has no counterpart"))
    return violations(bad, policy=policy, kind=kind, object_id=object_id, reason=reason, **contract)


@dataclass(frozen=True)
class Hop:
    """One step of a traversal: rows of ``child`` whose ``child_key`` equals the parent's key."""

    child: DataFrame
    parent_key: str
    child_key: str


def traverse(root: DataFrame, hops: Sequence[Hop]) -> DataFrame:
    """Follow declared hops; a parent without children keeps one row with NULLs."""
    out = root
    for hop in hops:
        out = out.join(hop.child, F.col(hop.parent_key) == F.col(hop.child_key), "left")
    return out


def resolve_reference(
    df: DataFrame, reference: str, targets: DataFrame, hfid: Sequence[str], target_id: str
) -> DataFrame:
    """Resolve an ``array<string>`` reference against the target's ordered key columns.

    Adds ``target_id`` and ``status``: ``resolved``, ``unresolved``, ``wrong_arity`` or ``absent``.
    A scalar reference is an array of one element.
    """
    fits = F.size(reference) == len(hfid)
    parts = df.select(
        "*", *[F.when(fits, F.get(reference, F.lit(i))).alias(f"_k{i}") for i in range(len(hfid))]
    )
    keyed = targets.select(
        *[F.col(c).cast("string").alias(f"_k{i}") for i, c in enumerate(hfid)],
        F.col(target_id).alias("target_id"),
    )
    joined = parts.join(keyed, [f"_k{i}" for i in range(len(hfid))], "left")
    status = (
        F.when(F.col(reference).isNull(), "absent")
        .when(~fits, "wrong_arity")
        .when(F.col("target_id").isNull(), "unresolved")
        .otherwise("resolved")
    )
    return joined.withColumn("status", status).drop(*[f"_k{i}" for i in range(len(hfid))])


def closure(
    references: DataFrame, emitted: DataFrame, live: DataFrame | None = None,
    keys: Sequence[str] = ("kind", "key"),
) -> DataFrame:
    """References that resolve neither in the emitted rows nor in the live ones.

    References are counted per target before the join, so a target named by a third of all rows is
    one row there. Without ``live`` the scope says ``emitted-only``: such orphans are a notice, not
    a failure.
    """
    keys = list(keys)
    wanted = references.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n_refs"))
    known = emitted.select(*keys)
    if live is not None:
        known = known.unionByName(live.select(*keys))
    scope = "emitted-only" if live is None else "emitted-and-live"
    return wanted.join(known, keys, "left_anti").withColumn("scope", F.lit(scope))


def missing_reverse(edges: DataFrame, local: str, remote: str) -> DataFrame:
    """Directed edges without the opposite edge; NULL remotes ignored, a loop is its own reverse."""
    pairs = edges.where(F.col(remote).isNotNull()).select(local, remote).distinct()
    opposite = pairs.select(F.col(local).alias("_to"), F.col(remote).alias("_from"))
    return pairs.join(
        opposite, (F.col(local) == F.col("_from")) & (F.col(remote) == F.col("_to")), "left_anti"
    )


def reverse_state(edges: DataFrame, local: str, remote: str, active: Column) -> DataFrame:
    """Active edges whose reverse is missing, or present but not active.

    Parallel edges are folded first: a pair is active when any of its edges is.
    """
    pairs = (
        edges.where(F.col(remote).isNotNull())
        .groupBy(local, remote)
        .agg(F.bool_or(active).alias("_active"))
    )
    opposite = pairs.select(
        F.col(local).alias("_to"), F.col(remote).alias("_from"), F.col("_active").alias("_back")
    )
    joined = pairs.where("_active").join(
        opposite, (F.col(local) == F.col("_from")) & (F.col(remote) == F.col("_to")), "left"
    )
    state = F.when(F.col("_back").isNull(), "missing").when(~F.col("_back"), "inactive")
    return joined.select(local, remote, state.alias("state")).where(F.col("state").isNotNull())


def _power_blocks(rows: DataFrame, first: Column, end: Column) -> DataFrame:
    """``rows`` once for each block ``size, block`` of 2**size bins that the bins from ``first`` to before ``end`` make up.

    The whole blocks of a size in the run are those from its low end rounded up to its high end rounded down; of these
    the outermost are the run's own where they are no half of a larger one.
    """
    shift = lambda n, k: F.call_function("shiftright", n, k)
    size, low, high = F.col("size"), F.col("_low"), F.col("_high")
    # shifts round down; from the negative side they round up
    ends = rows.withColumns({"_first": first, "_end": end}).select(
        "*", F.explode(F.sequence(F.lit(0), _largest(F.col("_first"), F.col("_end")))).alias("size")
    ).withColumns({"_low": -shift(-F.col("_first"), size), "_high": shift(F.col("_end"), size)})
    odd = (low % 2 != 0).cast("bigint")
    blocks = F.array(
        F.when((low < high) & (low % 2 != 0), low), F.when((low + odd < high) & (high % 2 != 0), high - 1)
    )
    return ends.withColumn("block", F.explode(blocks)).where(F.col("block").isNotNull()).drop("_first", "_end", "_low", "_high")


def _largest(first: Column, end: Column) -> Column:
    """The size of the largest block that fits into a run of bins."""
    return F.length(F.bin(end - first)) - 1


def interval_overlap(
    df: DataFrame,
    *,
    bucket: str,
    start: str,
    length: str,
    row_id: str,
    bin_width: int,
    condition: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Pairs of rows in one bucket whose half-open intervals ``[start, start + length)`` meet.

    NULL bucket or start is skipped; a NULL, zero or negative length counts as one. Positions are integers.
    Two intervals meet where the later one starts inside the earlier one. An interval is cut into blocks
    of a power of two of bins, so that even a very long one is a few dozen rows at most, and a start is
    listed once per size of block in use in its bucket. Blocks of an interval do not overlap: every pair
    appears once without a distinct, a bucket of any size is split over its blocks, and the join stays an
    equi-join on ``(bucket, size, block)``. ``condition`` may use the carried columns with the suffixes
    ``_a`` and ``_b``.
    """
    size = F.greatest(F.coalesce(F.col(length), F.lit(1)), F.lit(1))
    rows = df.where(F.col(bucket).isNotNull() & F.col(start).isNotNull()).select(
        F.col(bucket).alias("bucket"),
        F.col(row_id).alias("id"),
        F.col(start).cast("bigint").alias("s"),
        (F.col(start) + size).cast("bigint").alias("e"),
        *carry,
    )
    first = F.floor(F.col("s") / F.lit(bin_width)).cast("bigint")
    end = F.floor((F.col("e") - 1) / F.lit(bin_width)).cast("bigint") + 1
    early = _power_blocks(rows, first, end).select(
        "bucket", "size", "block", *[F.col(c).alias(f"{c}_a") for c in ("id", "s", "e", *carry)]
    )
    sizes = rows.groupBy("bucket").agg(F.max(_largest(first, end)).alias("_most"))
    late = rows.join(sizes, "bucket").select(
        "bucket",
        F.explode(F.sequence(F.lit(0), F.col("_most"))).alias("size"),
        first.alias("_first"),
        *[F.col(c).alias(f"{c}_b") for c in ("id", "s", "e", *carry)],
    ).withColumn("block", F.expr("shiftright(_first, size)")).drop("_first")
    meets = (F.col("s_b") < F.col("e_a")) & (
        (F.col("s_a") < F.col("s_b"))
        | ((F.col("s_a") == F.col("s_b")) & (F.col("id_a") < F.col("id_b")))
    )
    pairs = early.join(late, ["bucket", "size", "block"]).where(meets)
    if condition is not None:
        pairs = pairs.where(condition)
    return pairs.select(
        "bucket",
        F.least("id_a", "id_b").alias("id_low"),
        F.greatest("id_a", "id_b").alias("id_high"),
    )


def _prefix_matches(addresses: DataFrame, prefixes: DataFrame, address: str, prefix: str, scope: str) -> tuple[DataFrame, DataFrame]:
    """Readable addresses with their ``_ip``, and (scope, _ip, _len, prefix) for each prefix of the scope that holds one.

    Every distinct address lists its network for each prefix length in use in its scope and family (129 at most),
    which turns containment into an equi-join on ``(scope, family, length, network)``.
    """
    part = lambda name: F.col("_p")[name]
    approved = prefixes.select(scope, F.col(prefix).alias("_prefix"), ip_parts(F.col(prefix)).alias("_p")).where(F.col("_p").isNotNull())
    net = network_parts(part("hi"), part("lo"), part("length"))
    approved = approved.select(
        scope, part("family").alias("_family"), part("length").alias("_len"), net[0].alias("_hi"), net[1].alias("_lo"), "_prefix"
    ).groupBy(scope, "_family", "_len", "_hi", "_lo").agg(F.min("_prefix").alias("_prefix"))
    # an address is read once, and most are of the plain kind
    seen = addresses.withColumn("_four", ip_to_long(F.col(address))).withColumn(
        "_ip", F.when(F.col("_four").isNotNull(), F.struct(F.lit(4).alias("family"), F.lit(0).cast("bigint").alias("hi"), F.col("_four").alias("lo")))
        .otherwise(F.transform(F.array(ip_parts(F.col(address))), lambda p: F.struct(p["family"].alias("family"), p["hi"].alias("hi"), p["lo"].alias("lo")))[0])
    ).where(F.col("_ip.family").isNotNull()).drop("_four")
    seen = cut(seen, "addresses")
    lengths = approved.groupBy(scope, "_family").agg(F.collect_set("_len").alias("_lens"))
    distinct = seen.select(scope, "_ip", F.col("_ip.family").alias("_family")).distinct()
    candidates = distinct.join(lengths, [scope, "_family"]).select(scope, "_family", "_ip", F.explode("_lens").alias("_len"))
    net = network_parts(F.col("_ip.hi"), F.col("_ip.lo"), F.col("_len"))
    candidates = candidates.withColumns({"_hi": net[0], "_lo": net[1]})
    return seen, candidates.join(approved, [scope, "_family", "_len", "_hi", "_lo"]).select(scope, "_ip", "_len", "_prefix")


def cidr_containment(addresses: DataFrame, prefixes: DataFrame, *, address: str, scope: str, prefix: str = "prefix") -> DataFrame:
    """Addresses, IPv4 or IPv6, outside every approved ``prefix`` of their own scope and family.

    NULL addresses are left to :func:`without_any`, those that cannot be read to :func:`unreadable_addresses`;
    prefixes that cannot be read approve nothing.
    """
    seen, inside = _prefix_matches(addresses, prefixes, address, prefix, scope)
    return seen.join(inside.select(scope, "_ip").distinct(), [scope, "_ip"], "left_anti").drop("_ip")


def longest_prefix(addresses: DataFrame, prefixes: DataFrame, *, address: str, scope: str, prefix: str = "prefix") -> DataFrame:
    """Readable addresses with ``best_prefix``, the most specific prefix of their scope that holds them, or NULL."""
    seen, inside = _prefix_matches(addresses, prefixes, address, prefix, scope)
    best = inside.groupBy(scope, "_ip").agg(F.max_by("_prefix", "_len").alias("best_prefix"))
    return seen.join(best, [scope, "_ip"], "left").drop("_ip")


def unreadable_addresses(addresses: DataFrame, *, address: str) -> DataFrame:
    """Addresses that are given but neither IPv4 nor IPv6, which containment cannot judge."""
    return addresses.where(F.col(address).isNotNull() & ip_parts(F.col(address)).isNull())


def without_any(objects: DataFrame, details: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Objects that own no detail row at all."""
    return objects.join(details.select(*keys).distinct(), list(keys), "left_anti")


def window_impact(
    windows: DataFrame,
    scope: DataFrame,
    dependents: DataFrame,
    *,
    window_id: str,
    asset: str,
    dependent: str,
    customer: str,
    at: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Per active window the number of assets, distinct dependents and distinct customers.

    A window is active at ``start <= at < end``. ``scope`` maps windows to assets, ``dependents``
    assets to the dependents and customers riding on them. ``tasks`` as in :func:`impact_rows`.
    """
    assets, hit = _impact(windows, scope, dependents, window_id, asset, dependent, customer, at, tasks)
    # each count from its own distinct pairs: counted together, every row would be repeated for each of them
    counts = assets.groupBy(window_id).agg(F.count_distinct(asset).alias("n_assets"))
    for column, name in ((dependent, "n_dependents"), (customer, "n_customers")):
        pairs = hit.where(F.col(column).isNotNull()).select(window_id, column)
        pairs = (pairs if tasks is None else dealt(pairs, [window_id, column], tasks)).distinct()
        counts = counts.join(pairs.groupBy(window_id).agg(F.count("*").alias(name)), window_id, "left")
    return counts.select(window_id, "n_assets", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_dependents", "n_customers")])


def impact_rows(
    windows: DataFrame, scope: DataFrame, dependents: DataFrame, *, window_id: str, asset: str, dependent: str, customer: str,
    at: Column | None = None, tasks: int | None = None,
) -> DataFrame:
    """The lists behind :func:`window_impact`: each asset of an active window with each of its dependents and their customer.

    An asset without dependents is one row with NULLs. A list is rows, so that no asset's is gathered in one. ``tasks``
    is how many tasks the dependents are worth (:func:`stewardry.scale.tasks_for`); without it the session decides.
    """
    return _impact(windows, scope, dependents, window_id, asset, dependent, customer, at, tasks)[1].select(window_id, asset, dependent, customer)


def _impact(
    windows: DataFrame, scope: DataFrame, dependents: DataFrame, window_id: str, asset: str, dependent: str, customer: str,
    at: Column | None, tasks: int | None,
) -> tuple[DataFrame, DataFrame]:
    """The assets of the active windows, and these with their distinct dependents; those of other assets are left out first."""
    active = windows if at is None else windows.where((F.col("start") <= at) & (at < F.col("end")))
    assets = active.select(window_id).join(scope.select(window_id, asset).distinct(), window_id)
    riding = dependents.select(asset, dependent, customer)
    if tasks is not None:
        riding = dealt(riding, [asset], tasks)
    riding = riding.join(assets.select(asset), asset, "left_semi").distinct()
    return assets, assets.join(riding, asset, "left")


def dropdown_lookup(df: DataFrame, column: str, choices: DataFrame) -> DataFrame:
    """Distinct cell values with the choice they stand for: exact name, exact label, then any case.

    ``choices`` has ``name`` and ``label``. Values are counted first, so the join sees each once.
    ``status`` is ``matched``, ``ambiguous`` (several choices on the winning step) or ``unmatched``;
    nothing is guessed.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n_rows")
    )
    spellings = choices.select(
        F.col("name"),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("step"), F.col("name").alias("text")),
                F.struct(F.lit(2).alias("step"), F.col("label").alias("text")),
                F.struct(F.lit(3).alias("step"), F.lower("name").alias("text")),
                F.struct(F.lit(3).alias("step"), F.lower("label").alias("text")),
            )
        ).alias("s"),
    ).select("name", "s.step", "s.text")
    tries = values.select("value", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("step")).withColumn(
        "text", F.when(F.col("step") == 3, F.lower("value")).otherwise(F.col("value"))
    )
    steps = (
        tries.join(spellings, ["step", "text"])
        .groupBy("value", "step")
        .agg(F.min("name").alias("low"), F.max("name").alias("high"))
    )
    best = steps.groupBy("value").agg(F.min_by(F.struct("low", "high"), "step").alias("hit"))
    status = (
        F.when(F.col("hit").isNull(), "unmatched")
        .when(F.col("hit.low") != F.col("hit.high"), "ambiguous")
        .otherwise("matched")
    )
    return values.join(best, "value", "left").select(
        "value",
        "n_rows",
        F.when(status == "matched", F.col("hit.low")).alias("name"),
        status.alias("status"),
    )


def peer_mismatch(
    edges: DataFrame, nodes: DataFrame, *, peer: str, claimed: str, node_id: str, actual: str
) -> DataFrame:
    """Edges whose claim about the peer differs from the peer's own record."""
    record = nodes.select(F.col(node_id).alias(peer), F.col(actual).alias("actual"))
    return edges.join(record, peer).where(~F.col(claimed).eqNullSafe(F.col("actual")))


def undirected(
    links: DataFrame, a: str, b: str, order: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """One row per endpoint pair, the first seen; loops and links without remote end are dropped."""
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return (
        ends.groupBy(F.least(a, b).alias("end_low"), F.greatest(a, b).alias("end_high"))
        .agg(
            F.min_by(F.struct(*order, *[c for c in carry if c not in order]), F.struct(*order)).alias("_f"),
            F.count("*").alias("n_links"),
        )
        .select("end_low", "end_high", "n_links", "_f.*")
    )


def resolve_profiles(
    objects: DataFrame,
    assignments: DataFrame,
    profiles: DataFrame,
    attributes: Sequence[str],
    *,
    object_id: str,
    identity: Sequence[str] = (),
) -> DataFrame:
    """Explicit value, else the value of the assigned profile with the lowest priority number.

    Ties go to the lowest profile id. Adds ``<attr>_from_profile`` and ``<attr>_source``.
    ``assignments`` has the object id and ``profile_id``; ``profiles`` has ``profile_id``,
    ``priority`` and the attributes. Identity attributes cannot be profiled.
    """
    barred = sorted(set(attributes) & set(identity))
    if barred:
        raise ValueError(f"identity attributes cannot come from a profile: {barred}")
    values = profiles.select(
        "profile_id", "priority", *[F.col(a).alias(f"_p_{a}") for a in attributes]
    )
    rank = F.struct("priority", "profile_id")
    winners = (
        assignments.join(values, "profile_id")
        .groupBy(object_id)
        .agg(
            *[
                F.min_by(
                    F.struct(F.col(f"_p_{a}").alias("value"), F.col("profile_id").alias("source")),
                    F.when(F.col(f"_p_{a}").isNotNull(), rank),
                ).alias(f"_w_{a}")
                for a in attributes
            ]
        )
    )
    joined = objects.join(winners, object_id, "left")
    untouched = [F.col(c) for c in objects.columns if c not in attributes]
    resolved = []
    for a in attributes:
        inherited = F.col(a).isNull() & F.col(f"_w_{a}.value").isNotNull()
        resolved += [
            F.coalesce(F.col(a), F.col(f"_w_{a}.value")).alias(a),
            inherited.alias(f"{a}_from_profile"),
            F.when(inherited, F.col(f"_w_{a}.source")).alias(f"{a}_source"),
        ]
    return joined.select(*untouched, *resolved)


def resolve_profile_peers(
    own: DataFrame, assignments: DataFrame, profiles: DataFrame, peers: DataFrame, *, object_id: str
) -> DataFrame:
    """Peers of each object's relationships: ``relation, peer, from_profile, source``, own ones or a profile's.

    ``own`` has the object id, ``relation`` and ``peer``, ``peers`` the same of profiles by ``profile_id``. An object
    that sets any peer of a relationship overrides it as a whole; else the whole relationship comes from the one profile
    with the lowest priority number that sets it, ties to the lowest id. Lists of several profiles are never mixed.
    """
    rank = F.struct("priority", "profile_id")
    offered = peers.select("profile_id", "relation").distinct().join(profiles.select("profile_id", "priority"), "profile_id")
    winners = assignments.join(offered, "profile_id").groupBy(object_id, "relation").agg(F.min_by("profile_id", rank).alias("profile_id"))
    winners = winners.join(own.select(object_id, "relation").distinct(), [object_id, "relation"], "left_anti")
    inherited = winners.join(peers.distinct(), ["profile_id", "relation"]).select(
        object_id, "relation", "peer", F.lit(True).alias("from_profile"), F.col("profile_id").alias("source")
    )
    explicit = own.select(object_id, "relation", "peer").distinct().select(
        "*", F.lit(False).alias("from_profile"), F.lit(None).cast(inherited.schema["source"].dataType).alias("source")
    )
    return explicit.unionByName(inherited)


def instantiate_template(
    objects: DataFrame,
    templates: DataFrame,
    components: DataFrame,
    attributes: Sequence[str],
    *,
    object_id: str,
    template_id: str,
) -> tuple[DataFrame, DataFrame]:
    """Objects with template values copied where they set none, and their component children.

    A copy, not a live link. ``components`` holds one row per template and child.
    """
    defaults = templates.select(template_id, *[F.col(a).alias(f"_t_{a}") for a in attributes])
    filled = objects.join(defaults, template_id, "left").select(
        *[F.col(c) for c in objects.columns if c not in attributes],
        *[F.coalesce(F.col(a), F.col(f"_t_{a}")).alias(a) for a in attributes],
    )
    children = objects.select(object_id, template_id).join(components, template_id)
    return filled, children


def branch_view(
    base: DataFrame, overlay: DataFrame, key: str, *, aware: Sequence[str], agnostic: Sequence[str] = ()
) -> DataFrame:
    """The table as seen inside a branch.

    ``overlay`` has the key, the aware attributes (NULL = not set there) and ``_deleted``. Agnostic
    attributes always come from the base; a tombstone hides the row.
    """
    over = overlay.select(
        key, *[F.col(a).alias(f"_o_{a}") for a in aware], F.col("_deleted").alias("_gone")
    )
    joined = base.join(over, key, "full_outer").where(~F.coalesce("_gone", F.lit(False)))
    return joined.select(
        key, *[F.coalesce(f"_o_{a}", a).alias(a) for a in aware], *[F.col(a) for a in agnostic]
    )


def branch_diff(base: DataFrame, view: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows added, removed or changed between two versions, with the changed columns named."""
    old = base.select(key, F.struct(*columns).alias("_old"))
    new = view.select(key, F.struct(*columns).alias("_new"))
    changed = F.array_compact(
        F.array(*[F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in columns])
    )
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.size(changed) > 0, "changed")
    )
    return (
        old.join(new, key, "full_outer")
        .select(
            key,
            change.alias("change"),
            F.when(change == "changed", F.array_join(changed, ",")).alias("changed_columns"),
        )
        .where(F.col("change").isNotNull())
    )


def xref(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys used on the left but undefined on the right, and defined but unused."""
    used, defined = left.select(key).distinct(), right.select(key).distinct()
    undefined = used.join(defined, key, "left_anti").withColumn("direction", F.lit("undefined"))
    unused = defined.join(used, key, "left_anti").withColumn("direction", F.lit("unused"))
    return undefined.unionByName(unused)


def resolve_generic(
    references: DataFrame, targets: DataFrame, *, kind: str = "kind", key: str = "key"
) -> DataFrame:
    """References to a generic kind, resolved on the concrete kind they must name."""
    known = targets.select(kind, key, "target_id")
    status = (
        F.when(F.col(kind).isNull(), "kind_missing")
        .when(F.col("target_id").isNull(), "unresolved")
        .otherwise("resolved")
    )
    return references.join(known, [kind, key], "left").withColumn("status", status)


def common_parent(
    links: DataFrame, left: DataFrame, right: DataFrame, *, left_key: str, right_key: str, parent: str
) -> DataFrame:
    """Links whose two ends belong to different parents."""
    a = left.select(left_key, F.col(parent).alias("left_parent"))
    b = right.select(right_key, F.col(parent).alias("right_parent"))
    joined = links.join(a, left_key).join(b, right_key)
    return joined.where(~F.col("left_parent").eqNullSafe(F.col("right_parent")))


def error_to_source(errors: DataFrame, backrefs: DataFrame) -> DataFrame:
    """Input coordinates of validation errors.

    ``errors`` names ``file, row, attr``; ``backrefs`` maps ``file, row`` to ``src_file`` and the
    interval ``line_from..line_to`` (a collapsed range covers several lines) and lists the columns
    as a map ``columns`` from attribute to input column. A child row carries ``parent_row``, whose
    coordinates it inherits when it has none.
    """
    own = backrefs.select("file", "row", "src_file", "line_from", "line_to", "parent_row", "columns")
    parents = backrefs.select(
        F.col("file"),
        F.col("row").alias("parent_row"),
        F.col("src_file").alias("_pf"),
        F.col("line_from").alias("_p1"),
        F.col("line_to").alias("_p2"),
    )
    return (
        errors.join(own, ["file", "row"], "left")
        .join(parents, ["file", "parent_row"], "left")
        .select(
            "file",
            "row",
            "attr",
            F.coalesce("src_file", "_pf").alias("src_file"),
            F.coalesce("line_from", "_p1").alias("line_from"),
            F.coalesce("line_to", "_p2").alias("line_to"),
            F.try_element_at("columns", F.col("attr")).alias("src_column"),
        )
    )


def unpivot_text(df: DataFrame, columns: Mapping[str, str] | Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows ``(keep.., column, value)`` of the named text columns."""
    return df.unpivot(list(keep), list(columns), "column", "value")
