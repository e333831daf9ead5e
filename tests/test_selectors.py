"""Each selector against a plain version, on random grids and all four segmentations."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessel.functions.grids import Frame
from tessel.functions.labels import objects
from tessel.functions.selectors import SELECTORS, Objects
from tessel.sources.grids import from_text

VALUE = 2


def described(grid, seg):
    labels, holes = (x[0].as_py() for x in objects(pa.array([grid], pa.list_(pa.list_(pa.int32()))), seg))
    found = []
    for k in range(1, max(map(max, labels)) + 1):
        cells = [(r, c) for r, row in enumerate(labels) for c, n in enumerate(row) if n == k]
        r0, r1, c0, c1 = min(r for r, _ in cells), max(r for r, _ in cells), min(c for _, c in cells), max(c for _, c in cells)
        values = [grid[r][c] for r, c in cells]
        around = {(r + y, c + x) for r, c in cells for y in (-1, 0, 1) for x in (-1, 0, 1)} - set(cells)
        found.append(
            {
                "k": k, "size": len(cells), "r0": r0, "c0": c0, "r1": r1, "c1": c1, "h": r1 - r0 + 1, "w": c1 - c0 + 1, "color": min(Counter(values), key=lambda v: (-Counter(values)[v], v)), "holes": holes[k - 1],
                "shape": (frozenset((r - r0, c - c0) for r, c in cells)), "many": len(set(values)) > 1, "border": r0 == 0 or c0 == 0 or r1 == len(grid) - 1 or c1 == len(grid[0]) - 1,
                "near": {grid[r][c] for r, c in around if 0 <= r < len(grid) and 0 <= c < len(grid[0])},
                "even": set(cells) == {(r, c0 + c1 - c) for r, c in cells} or set(cells) == {(r0 + r1 - r, c) for r, c in cells},
            }
        )
    return found


def chosen(found, by):
    if not found:
        return []
    most = lambda name: [o for o in found if o[name] == max(x[name] for x in found)]
    least = lambda name: [o for o in found if o[name] == min(x[name] for x in found)]
    colors, shapes = Counter(o["color"] for o in found), Counter(o["shape"] for o in found)
    rect = lambda o: o["size"] == o["h"] * o["w"]
    return {
        "all": found, "largest": most("size"), "smallest": least("size"), "tallest": most("h"), "widest": most("w"), "leftmost": least("c0"), "topmost": least("r0"), "rightmost": most("c1"), "bottommost": most("r1"),
        "common_color": [o for o in found if colors[o["color"]] == max(colors.values())], "rare_color": [o for o in found if colors[o["color"]] == min(colors.values())],
        "common_shape": [o for o in found if shapes[o["shape"]] == max(shapes.values())], "dup_shape": [o for o in found if shapes[o["shape"]] > 1], "unique_shape": [o for o in found if shapes[o["shape"]] == 1],
        "touching": [o for o in found if VALUE in o["near"]], "holes_eq": [o for o in found if o["holes"] == VALUE], "has_hole": [o for o in found if o["holes"]], "no_hole": [o for o in found if not o["holes"]],
        "square": [o for o in found if rect(o) and o["h"] == o["w"]], "symmetric": [o for o in found if o["even"]], "color": [o for o in found if o["color"] == VALUE], "not_color": [o for o in found if o["color"] != VALUE],
        "size_eq": [o for o in found if o["size"] == VALUE], "size_gt": [o for o in found if o["size"] > VALUE], "size_lt": [o for o in found if o["size"] < VALUE], "touches_border": [o for o in found if o["border"]],
        "inner": [o for o in found if not o["border"]], "rect": [o for o in found if rect(o)], "not_rect": [o for o in found if not rect(o)], "multicolor": [o for o in found if o["many"]],
    }[by]


@pytest.mark.parametrize("seg", ["c4", "c8", "m4", "m8"])
def test_selectors(spark, seg):
    rng = np.random.default_rng(7)
    grids = {i: np.where(rng.random((h, w)) < p, rng.integers(1, 4, (h, w)), 0).tolist() for i, (h, w, p) in enumerate([(6, 7, 0.5), (8, 8, 0.3), (7, 9, 0.7), (3, 3, 0.0), (1, 1, 1.0), (9, 9, 0.85)])}
    f = Frame(from_text(spark, [(i, " ".join("".join(map(str, row)) for row in g)) for i, g in grids.items()]))
    o = Objects(f, seg)
    picked = F.array(*[F.transform(o.select({"by": name, "value": VALUE}), lambda x: x["k"]) for name in SELECTORS])
    for row in f.df.select("gid", picked.alias("picked")).collect():
        found = described(grids[row["gid"]], seg)
        for name, numbers in zip(SELECTORS, row["picked"]):
            assert (name, numbers) == (name, [x["k"] for x in chosen(found, name)])
