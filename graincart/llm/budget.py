"""Whole-number budgets over trees of categories. Trees are small: their leaves are the rows of a table of targets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction


@dataclass
class Leaf:
    """A category: `path` from the root's child down, its `weight`, what it can give at most, what it should give at least.

    An allocation sets the rest: its whole `demand`, what is `given`, what it `lacks` of its exact part of the total, and whether it is `below` its floor.
    """

    path: tuple[str, ...]
    weight: int | Fraction
    capacity: int
    floor: int = 0
    demand: int = 0
    given: int = 0
    lacks: Fraction = Fraction(0)
    below: bool = False


def portions(total: int, weights: Sequence[int | Fraction]) -> list[int]:
    """`total` in proportion to `weights` by largest remainder; ties go to the earlier one. No weight, no portion."""
    whole = sum(weights)
    if total <= 0 or whole <= 0:
        return [0] * len(weights)
    parts = [total * w // whole for w in weights]
    rest = sorted(range(len(weights)), key=lambda i: (-(total * weights[i] % whole), i))
    for i in rest[: total - sum(parts)]:
        parts[i] += 1
    return parts


def _pour(leaves: list[Leaf], amount: int) -> int:
    """Give `amount` to the leaves with room, by weight, until it or the room is used up. What is left over."""
    while amount > 0:
        open_ = [x for x in leaves if x.given < x.capacity]
        if not open_:
            break
        weights = [x.weight for x in open_]
        parts = portions(amount, weights if sum(weights) else [1] * len(open_))
        placed = 0
        for leaf, part in zip(open_, parts):
            more = min(part, leaf.capacity - leaf.given)
            leaf.given += more
            placed += more
        amount -= placed
        if not placed:
            break
    return amount


def allocate(leaves: list[Leaf], total: int, base: int | None = None) -> int:
    """Set demand, given, lacks and below of each leaf, top down, and return how much of `total` nobody could give.

    Each node's part of the total is its leaves' weight; a leaf gets its part, at least its floor, at most its
    capacity. What a leaf cannot give goes to its siblings, what they cannot give to the cousins below the next
    ancestor, and so on up to the root, always by weight. If the floors ask for more than their parts, the leaves
    with the most above their floors give way. The order of the leaves only decides ties. A leaf's exact part, which it may lack some of, is its weight
    in `base` (by default, in the sum of the weights).
    """
    base = base or sum(x.weight for x in leaves)
    for leaf, part in zip(leaves, portions(total, [x.weight for x in leaves])):
        leaf.lacks = max(Fraction(0), Fraction(total) * leaf.weight / base - leaf.capacity) if base else Fraction(0)
        leaf.below = leaf.capacity < leaf.floor
        leaf.demand = part
        leaf.given = min(leaf.capacity, max(part, leaf.floor))
    over = sum(x.given for x in leaves) - total
    while over > 0:
        spare = [x for x in leaves if x.given > min(x.floor, x.capacity)]
        if not spare:
            break
        for leaf, part in zip(spare, portions(over, [x.given - min(x.floor, x.capacity) for x in spare])):
            leaf.given -= min(part, leaf.given - min(leaf.floor, leaf.capacity))
        left = sum(x.given for x in leaves) - total
        if left == over:
            break
        over = left
    depth = max((len(x.path) for x in leaves), default=0)
    open_ = {x.path: max(0, min(x.demand, total) - x.given) for x in leaves}
    room = max(0, total - sum(x.given for x in leaves))
    for level in range(depth - 1, -1, -1):
        groups: dict[tuple[str, ...], list[Leaf]] = {}
        for leaf in leaves:
            groups.setdefault(leaf.path[:level], []).append(leaf)
        for members in groups.values():
            want = min(room, sum(open_[x.path] for x in members))
            left = _pour(members, want)
            room -= want - left
            for x in members:
                open_[x.path] = 0
            if left and members:
                open_[members[0].path] = left
    return room
