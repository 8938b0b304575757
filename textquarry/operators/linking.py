"""Figures, words and passages on a page: what belongs together, and where it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textquarry.functions.scoring import nearness
from textquarry.functions.text import labels_in

BY_LABEL, SAME_PAGE, MOST_RECTS = 10.0, 0.5, 120
#: Characters of a stretch of text; ranges are joined on the stretches that they lie in.
STRETCH = 4096
#: Pairs of a page's items, with their rectangles and labels, that a task compares at once; a page of more is compared in blocks of its own.
PAIRS = 1 << 18
#: Bytes of pages that a worker splits into words at once.
HELD = 1 << 20


def label_pairs(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """JOIN4: figure and passage of an asset that share a label; a figure's label is the first of its nearby text, else its caption's."""
    own = lambda c: F.array_min(labels_in(c))
    a = figures.select("asset_id", F.col("chunk_order").alias("image"), F.coalesce(own(F.col("nearby_text")), own(F.col("caption"))).alias("l")).where("l is not null").select("asset_id", "image", "l.kind", "l.number")
    b = texts.select("asset_id", F.col("chunk_order").alias("text"), F.explode(labels_in(F.col("content"))).alias("l")).select("asset_id", "text", "l.kind", "l.number")
    return a.join(b, ["asset_id", "kind", "number"]).select("asset_id", "image", "text", F.lit(BY_LABEL).alias("score"))


def page_pairs(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """JOIN5: figure and passage of a page, the nearer the stronger."""
    a = figures.select("asset_id", "page", F.col("chunk_order").alias("image"), "bbox", "whole_page")
    b = texts.select("asset_id", "page", F.col("chunk_order").alias("text"), "rects")
    near = F.when(F.col("whole_page") | F.col("rects").isNull(), F.lit(0.0)).otherwise(4 * F.coalesce(nearness(F.col("rects"), F.col("bbox")), F.lit(0.0)))
    return a.join(b, ["asset_id", "page"]).select("asset_id", "image", "text", (SAME_PAGE + near).alias("score"))


def links(figures: DataFrame, texts: DataFrame, per_image: int = 2, per_text: int = 2) -> DataFrame:
    """JOIN6: both kinds of evidence added up; each side's best partners, a row for each choice, with which side made it.

    An item is on one page of its asset. Only pairs that can be among a side's best are made, so they are linear in figures
    and passages, and no pair is shuffled. Of a label, the partners on other pages all score alike: of each side the first few are
    enough. A page gets them for its labels, and there every item's partners are chosen at once, from its page and from elsewhere.
    """
    label = lambda c: F.concat(c["kind"], F.lit(":"), c["number"])
    own = lambda c: F.array_min(labels_in(c))
    # Labels are found once; what is made of one is a step of its own.
    found = figures.select("asset_id", "page", F.col("chunk_order").alias("image"), F.coalesce(own(F.col("nearby_text")), own(F.col("caption"))).alias("_l"), F.col("bbox").cast("array<double>").alias("bbox"), "whole_page")
    a = found.select("asset_id", "page", "image", label(F.col("_l")).alias("label"), "bbox", "whole_page")
    b = texts.select("asset_id", "page", F.col("chunk_order").alias("text"), F.transform(labels_in(F.col("content")), label).alias("labels"), F.col("rects").cast("array<array<double>>").alias("rects"))
    kind = dict(a.dtypes)["asset_id"], dict(a.dtypes)["image"], dict(b.dtypes)["text"]
    both = a.withColumn("_text", F.lit(False)).unionByName(b.withColumn("_text", F.lit(True)), allowMissingColumns=True)
    both = both.unionByName(_elsewhere(a, b, max(per_image, per_text)), allowMissingColumns=True).where("asset_id is not null")
    both = both.select("asset_id", "page", "_text", "image", "label", "bbox", "whole_page", "text", "labels", "rects", "_side", "times")
    # Dealt out and sorted by page, a task compares its pages as they come, many at a time: what a page costs is its pairs, not a call. Only a page itself is held whole.
    dealt = both.repartition("asset_id", "page").sortWithinPartitions("asset_id", "page", "_text", "image", "text")
    return dealt.mapInArrow(_pages_best(per_image, PAIRS, per_text), "asset_id {}, image {}, text {}, score double, of_image boolean, of_text boolean".format(*kind))


def _elsewhere(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """For each page and label there, the first k items that have the label on other pages: passages if the page has figures of it, figures if it has passages.

    Of a page no more than k items of a label and side are looked at; of all pages' the first 2 k are enough: whichever page is left out, its first k others are among them.
    """
    named = a.select("asset_id", "page", "image", F.lit(None).cast(dict(b.dtypes)["text"]).alias("text"), F.array("label").alias("labels"))
    naming = b.select("asset_id", "page", F.lit(None).cast(dict(a.dtypes)["image"]).alias("image"), "text", "labels")
    # An outer explode: for an inner one, or for a filter below it, labels would be searched a second time.
    rows = named.withColumn("_side", F.lit(False)).unionByName(naming.withColumn("_side", F.lit(True))).where("asset_id is not null")
    rows = rows.select("asset_id", F.explode_outer("labels").alias("label"), "page", "_side", "image", "text").where("label is not null")
    rows = rows.repartition("asset_id", "label", "page").groupBy("asset_id", "label", "page", "_side", "image", "text").agg(F.count(F.lit(1)).alias("times"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("times"), "image", "text"))
    rows = rows.withColumn("_p", place("asset_id", "label", "page", "_side")).where(F.col("_p") <= k).repartition("asset_id", "label")
    rows = rows.withColumn("_w", place("asset_id", "label", "_side"))
    first = F.collect_list(F.when(F.col("_w") <= 2 * k, F.struct("_w", "_side", "page", "image", "text", "times"))).over(Window.partitionBy("asset_id", "label"))
    cells = rows.withColumn("_first", first).where("_p = 1")
    others = F.filter("_first", lambda x: (x["_side"] != F.col("_side")) & ~F.coalesce(x["page"] == F.col("page"), F.lit(False)))
    return cells.select("asset_id", "page", "label", F.explode(F.slice(F.array_sort(others), 1, k)).alias("_o")).select("asset_id", "page", "label", "_o.image", "_o.text", "_o._side", "_o.times")


def _pages_best(per_image: int, most: int = PAIRS, per_text: int | None = None):
    per_text = per_image if per_text is None else per_text
    k = max(per_image, per_text)
    one = _page_best(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, page in _whole_pages(batches):
            text = pc.fill_null(rows["_text"], False).to_numpy(zero_copy_only=False)
            far = pc.is_null(rows["_text"]).to_numpy(zero_copy_only=False)
            at_a, at_b = np.flatnonzero(~text & ~far), np.flatnonzero(text)
            figures, texts = rows.take(pa.array(at_a)), rows.take(pa.array(at_b))
            page_a, page_b = page[at_a], page[at_b]
            pages = int(page[-1]) + 1
            begins = np.searchsorted(page, np.arange(pages))
            n_a, n_b = np.bincount(page_a, minlength=pages), np.bincount(page_b, minlength=pages)
            size = 1 + sum(pc.fill_null(pc.list_value_length(texts[c]), 0).to_numpy(zero_copy_only=False) for c in ("labels", "rects"))
            pairs = n_a * np.bincount(page_b, size, pages).astype(np.int64)
            pairs[pc.is_null(rows["page"]).to_numpy(zero_copy_only=False)[begins]] = 0  # what is on no page has no neighbours
            alone = pairs > most
            first_a, first_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
            met = np.flatnonzero((pairs > 0) & ~alone)
            part = np.cumsum(pairs[met]) // most  # consecutive pages of so many pairs together
            near = []
            for low, high in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right"))):
                p, q = met[low], met[high - 1] + 1
                ours = np.zeros(pages, bool)
                ours[met[low:high]] = True
                a, b = (t.slice(first[p], first[q] - first[p]) for t, first in ((figures, first_a), (texts, first_b)))
                near.append((p, _pairs_best(a, b, page_a[first_a[p] : first_a[q]] - p, page_b[first_b[p] : first_b[q]] - p, ours[p:q], k)))
            for p in np.flatnonzero((pairs > 0) & alone):
                near.append((p, one(figures.slice(first_a[p], n_a[p]), texts.slice(first_b[p], n_b[p]))))
            found = [(p + t["_page"].to_numpy(), t["image"], t["text"], t["score"].to_numpy()) for p, t in near]
            others = rows.filter(pa.array(far))
            for side, own, other, n in (("of_image", "image", "text", per_image), ("of_text", "text", "image", per_text)):
                items, at = (figures, page_a) if own == "image" else (texts, page_b)
                chosen = _chosen(found + _far_pairs(items, at, others, page[far], own, other), own, other, n)
                if chosen is not None:
                    at, image, text, score = chosen
                    flags = {c: pa.array(np.full(len(at), c == side)) for c in ("of_image", "of_text")}
                    yield from pa.table({"asset_id": rows["asset_id"].take(pa.array(begins[at])), "image": image, "text": text, "score": pa.array(score)} | flags).to_batches()

    return run


def _far_pairs(items: pa.Table, at: np.ndarray, others: pa.Table, page: np.ndarray, own: str, other: str) -> list[tuple]:
    """Pairs of a page's items with those on other pages that share a label: page, image, text and score."""
    if not others.num_rows:
        return []
    there = (others["_side"].to_numpy(zero_copy_only=False) == (other == "text")).astype(bool)
    others, page = others.filter(pa.array(there)), page[there]
    if not len(page) or not len(at):
        return []
    if own == "image":
        row, labels = np.arange(len(at)), items["label"].combine_chunks()
    else:
        _, size, labels = _lists(items["labels"])
        row = _spread(size)[0]
    ids = pa.concat_arrays([others["label"].combine_chunks(), labels]).dictionary_encode()
    codes = pc.fill_null(ids.indices, -1).to_numpy()
    width = len(ids.dictionary) + 1
    key, asked = page * width + codes[: len(page)], at[row] * width + codes[len(page) :]
    order = np.argsort(key, kind="stable")
    low, high = (np.searchsorted(key[order], asked, side) for side in ("left", "right"))
    hit, place = _spread(np.where(codes[len(page) :] >= 0, high - low, 0))
    row, o = row[hit], order[low[hit] + place]
    score = BY_LABEL * others["times"].to_numpy()[o]
    # Rows of one item are added up.
    item = _ranks(items[own])[row]
    name = _ranks(others[other])[o]
    order = np.lexsort((name, item, at[row]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(x[order]) != 0 for x in (name, item, at[row])], axis=0)
    first = order[new]
    if not len(first):
        return []
    mine, theirs = items[own].take(pa.array(row[first])), others[other].take(pa.array(o[first]))
    return [(at[row[first]], *((mine, theirs) if own == "image" else (theirs, mine)), np.add.reduceat(score[order], np.flatnonzero(new)))]


def _chosen(found: list[tuple], own: str, other: str, n: int) -> tuple | None:
    """Of pairs, a page's items' n best each, as ranked: the highest score first, ties to the first partner."""
    if not found:
        return None
    at, score = (np.concatenate([f[c] for f in found]) for c in (0, 3))
    ids = {name: pa.chunked_array([x for f in found for x in f[c].chunks]) for c, name in ((1, "image"), (2, "text"))}
    item = _ranks(ids[own])
    order = np.lexsort((_ranks(ids[other]), -np.round(score, 9), item, at))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(item[order]) != 0) | (np.diff(at[order]) != 0)
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    kept = order[place < n]
    return at[kept], ids["image"].take(pa.array(kept)), ids["text"].take(pa.array(kept)), score[kept]


def _ranks(items: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are ordered as the items are, equal for equal ones."""
    return pc.rank(items.combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables that end where a page ends, and the number of each row's page in its table."""
    held: list[pa.RecordBatch] = []
    opens: list[np.ndarray] = []  # whether a page begins at a row
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in range(2)]
        new = np.ones(batch.num_rows, bool)
        after = [(c.slice(1), c.slice(0, len(c) - 1)) for c in keys]
        new[1:] = np.any([pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False) for x, y in after], axis=0)
        new[0] = last != tuple(c[0].as_py() for c in keys)
        last = tuple(c[-1].as_py() for c in keys)
        begins = np.flatnonzero(new)
        cut = int(begins[-1]) if len(begins) else 0
        if len(begins) and (held or cut):
            rows, marks = [*held, batch.slice(0, cut)], np.concatenate([*opens, new[:cut]])
            yield pa.Table.from_batches(rows).combine_chunks(), np.cumsum(marks) - 1
        if len(begins):
            held, opens = [], []
        held.append(batch.slice(cut))
        opens.append(new[cut:])
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.cumsum(np.concatenate(opens)) - 1


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many items: each item's group, and its number there."""
    group = np.repeat(np.arange(len(n)), n)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Begin and length of each row's list, null as empty, in the items of all."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(size) - size, size, column.flatten()


def _corners(boxes: pa.Array) -> np.ndarray:
    """The first four numbers of each list, NaN for those that are missing."""
    begin, size, flat = _lists(boxes)
    flat = flat.to_numpy(zero_copy_only=False)
    out = np.full((len(size), 4), np.nan)
    for c in range(4):
        has = size > c
        out[has, c] = flat[begin[has] + c]
    return out


def _items(item: pa.ChunkedArray, page: np.ndarray) -> np.ndarray:
    """Numbers of a page's items, from rows in their order."""
    item = item.combine_chunks()
    new = np.ones(len(page), bool)
    new[1:] = pc.fill_null(pc.not_equal(item.slice(1), item.slice(0, len(page) - 1)), False).to_numpy(zero_copy_only=False) | (page[1:] != page[:-1])
    return np.cumsum(new) - 1


def _pairs_best(figures: pa.Table, texts: pa.Table, page_a: np.ndarray, page_b: np.ndarray, ours: np.ndarray, k: int) -> pa.Table:
    """_page_best of many pages at once: all pairs of figure and passage of those of our pages. Rows are in the order of their items."""
    n_b = np.where(ours, np.bincount(page_b, minlength=len(ours)), 0)
    first_b = np.cumsum(np.bincount(page_b, minlength=len(ours))) - np.bincount(page_b, minlength=len(ours))
    f, t = _spread(n_b[page_a])
    t += first_b[page_a[f]]
    score = np.full(len(f), SAME_PAGE)
    box, whole = _corners(figures["bbox"]), pc.fill_null(figures["whole_page"], False).to_numpy(zero_copy_only=False)
    begin, size, rects = _lists(texts["rects"])
    flat = _corners(rects)
    near = np.flatnonzero((size[t] > 0) & ~(whole | np.isnan(box).any(axis=1))[f])
    if len(near):
        group, at = _spread(size[t[near]])
        starts = np.cumsum(size[t[near]]) - size[t[near]]
        score[near] += 4 * np.maximum(0.0, _near(flat[begin[t[near]][group] + at], box[f[near]][group].T, starts))
    begin, size, labels = _lists(texts["labels"])
    codes = pa.concat_arrays([pc.fill_null(figures["label"], "").combine_chunks(), labels]).dictionary_encode().indices.to_numpy()
    named, codes = codes[: len(page_a)], codes[len(page_a) :]
    some = np.flatnonzero((size[t] > 0) & pc.is_valid(figures["label"]).to_numpy(zero_copy_only=False)[f])
    if len(some):
        group, at = _spread(size[t[some]])
        hit = codes[begin[t[some]][group] + at] == named[f[some]][group]
        score[some] += BY_LABEL * np.bincount(group[hit], minlength=len(some))
    image, passage = _items(figures["image"], page_a), _items(texts["text"], page_b)
    if image[-1] + 1 < len(image) or passage[-1] + 1 < len(passage):  # rows of one item are added up
        pair, first, at = np.unique(image[f] * len(passage) + passage[t], return_index=True, return_inverse=True)
        score, f, t = np.bincount(at, score, len(pair)), f[first], t[first]
        f, t = np.searchsorted(image, image[f]), np.searchsorted(passage, passage[t])
    worst = -np.round(score, 9)
    kept = np.zeros(len(f), bool)
    for own, other in ((f, t), (t, f)):
        order = np.lexsort((other, worst, own))
        place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
        kept[order[place < k]] = True
    f, t = f[kept], t[kept]
    return pa.table({"asset_id": figures["asset_id"].take(pa.array(f)), "image": figures["image"].take(pa.array(f)), "text": texts["text"].take(pa.array(t)), "score": pa.array(score[kept]), "_page": pa.array(page_a[f])})


def _page_best(k: int, block: int = 256):
    def run(figures: pa.Table, texts: pa.Table) -> pa.Table:
        images, at = np.unique(figures["image"].to_numpy(), return_inverse=True)
        names, place = np.unique(texts["text"].to_numpy(), return_inverse=True)
        empty = pa.table({"asset_id": figures["asset_id"].slice(0, 0), "image": figures["image"].slice(0, 0), "text": texts["text"].slice(0, 0), "score": pa.array([], pa.float64()), "_page": pa.array([], pa.int64())})
        if not len(images) or not len(names):
            return empty
        # All rectangles in one array; a passage's are consecutive.
        rects = texts["rects"].to_pylist()
        flat = np.array([r[:4] for own in rects for r in own or ()], np.float64).reshape(-1, 4)
        sizes = np.array([len(own or ()) for own in rects])
        some = np.flatnonzero(sizes)
        starts = np.r_[0, np.cumsum(sizes[some])[:-1]].astype(np.int64) if len(some) else np.zeros(0, np.int64)
        by_label: dict[str, list[int]] = {}
        for row, labels in enumerate(texts["labels"].to_pylist()):
            for name in labels or ():
                by_label.setdefault(name, []).append(row)
        boxes, whole, label = figures["bbox"].to_pylist(), figures["whole_page"].to_pylist(), figures["label"].to_pylist()
        order = np.argsort(at, kind="stable")
        out, best_s, best_i = [], np.full((len(names), k), -np.inf), np.full((len(names), k), -1)
        edges = np.unique(np.r_[np.searchsorted(at[order], np.arange(0, len(images), block)), len(order)])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows = order[low:high]
            first = int(at[rows[0]])
            score = np.zeros((int(at[rows[-1]]) - first + 1, len(names)))
            for row in rows.tolist():
                one = np.full(len(rects), SAME_PAGE)
                if len(flat) and not whole[row] and boxes[row] and None not in boxes[row][:4]:
                    one[some] += 4 * np.maximum(0.0, _near(flat, boxes[row], starts))
                if label[row] in by_label:
                    np.add.at(one, by_label[label[row]], BY_LABEL)
                score[int(at[row]) - first] += np.bincount(place, one, len(names))
            own = np.arange(first, first + len(score))
            top = _best_columns(score, k)
            out += [(np.repeat(own, top.shape[1]), top.ravel(), np.take_along_axis(score, top, 1).ravel())]
            seen = np.concatenate([best_s, score.T], axis=1)
            who = np.concatenate([best_i, np.broadcast_to(own, (len(names), len(own)))], axis=1)
            top = _best_columns(seen, k)
            best_s, best_i = np.take_along_axis(seen, top, 1), np.take_along_axis(who, top, 1)
        row, column = np.nonzero(best_i >= 0)
        out.append((best_i[row, column], row, best_s[row, column]))
        i, t, s = (np.concatenate([o[c] for o in out]) for c in range(3))
        _, once = np.unique(i * len(names) + t, return_index=True)  # both sides may have chosen a pair
        i, t, s = i[once], t[once], s[once]
        asset = figures["asset_id"][0].as_py()
        return pa.table({"asset_id": pa.array([asset] * len(i), figures["asset_id"].type), "image": pa.array(images[i], figures["image"].type), "text": pa.array(names[t], texts["text"].type), "score": pa.array(s), "_page": pa.array(np.zeros(len(i), np.int64))})

    return run


def _near(rects: np.ndarray, box: list[float] | np.ndarray, starts: np.ndarray, most: float = 250.0, side: float = 20.0) -> np.ndarray:
    """MTH10 of consecutive groups of rectangles to a box, or to a box each."""
    x0, y0, x1, y1 = box[:4]
    gap = np.where(rects[:, 1] >= y1, rects[:, 1] - y1, np.where(rects[:, 3] <= y0, y0 - rects[:, 3], 0.0))
    gap = np.where((rects[:, 2] >= x0 - side) & (rects[:, 0] <= x1 + side), gap, np.inf)
    best = np.minimum.reduceat(gap, starts)
    return np.where(best <= most, 1 - best / most, 0.0)


def _best_columns(score: np.ndarray, k: int) -> np.ndarray:
    """Each row's k columns with the highest score, rounded as ranks are, ties to the first."""
    return np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]


def _binned(df: DataFrame, begin: str, end: str, first: str) -> DataFrame:
    """A row for each stretch of STRETCH characters that a range lies in: bin, and the first of them."""
    low = F.floor(F.col(begin) / STRETCH)
    high = F.greatest(low, F.floor((F.col(end) - 1) / STRETCH))
    return df.select("*", low.alias(first), F.explode(F.sequence(low, high)).alias("bin"))


def words_of_chunks(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """JOIN8: the words whose range meets a passage's, page by page; words of split_words bring their stop, others' comes from the word.

    Words of words_by_stretch are taken from their stretch only where it meets a passage.
    """
    c = chunks.select("asset_id", "page", "chunk_order", F.col("start").alias("c_from"), (F.col("start") + F.length("content")).alias("c_to"))
    c = _binned(c, "c_from", "c_to", "c_bin")
    if "begins" in words.columns:
        met = c.join(words, ["asset_id", "page", "bin"]).select("*", F.posexplode("begins").alias("_at", "_from")).where(F.col("_at") < F.size("begins") - 1)
        here = F.col("bin") * STRETCH
        met = met.withColumns({"word_no": F.col("first_no") + F.col("_at"), "begin": here + F.col("_from"), "stop": here + F.get("begins", F.col("_at") + 1) - F.col("gap")})
        met = met.withColumn("w_bin", F.floor(F.col("begin") / STRETCH)).drop("first_no", "begins", "gap", "_at", "_from")
    else:
        stop = F.col("stop") if "stop" in words.columns else F.col("start") + F.length("word")
        met = c.join(_binned(words.withColumn("stop", stop).withColumnRenamed("start", "begin"), "begin", "stop", "w_bin"), ["asset_id", "page", "bin"])
    # Ranges meet in the first stretch that both lie in, and in no other.
    return met.where("begin < c_to and stop > c_from and bin = greatest(w_bin, c_bin)").drop("c_from", "c_to", "stop", "bin", "w_bin", "c_bin")


def split_words(pages: DataFrame, sign: str = " ") -> DataFrame:
    """Words of pages(asset_id, page, text) between single signs, numbered from 1, with start and stop; a page's own row tells them all, so nothing is shuffled."""
    kinds = [pages.schema[c] for c in ("asset_id", "page")]
    schema = T.StructType([*kinds, T.StructField("word_no", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, row, at, words, start, size in _split(batches, sign):
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays([own.column(0).take(place), own.column(1).take(place), pa.array((at + 1).astype(np.int32)), words.cast(pa.string()), pa.array(start), pa.array(start + size)], names=schema.names)

    return pages.select("asset_id", "page", "text").mapInArrow(run, schema)


def words_by_stretch(pages: DataFrame, sign: str = " ") -> DataFrame:
    """split_words without the words themselves, a row for each stretch of a page (bin): the first word's number, where its words begin from
    the stretch's begin on, with what would come after the last, and the sign's length. A word is in every stretch that it lies in."""
    kinds = [pages.schema[c] for c in ("asset_id", "page")]
    schema = T.StructType([*kinds, T.StructField("bin", T.LongType()), T.StructField("first_no", T.IntegerType()), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("gap", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, row, at, _, start, size in _split(batches, sign):
            if not len(row):
                continue
            low = start // STRETCH
            high = np.maximum(low, (start + size - 1) // STRETCH)
            # Words are in order, and so are their stretches: those of a stretch are consecutive.
            wide = int(high.max()) + 1
            lies, more = _spread(high - low + 1)
            key = np.unique((row * wide + low)[lies] + more)
            first, end = np.searchsorted(row * wide + high, key), np.searchsorted(row * wide + low, key, "right")
            group, place = _spread(end - first + 1)
            word = np.minimum(first[group] + place, end[group] - 1)
            begins = start[word] + np.where(place < (end - first)[group], 0, size[word] + len(sign)) - (key % wide * STRETCH)[group]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(end - first + 1)].astype(np.int32)), pa.array(begins.astype(np.int32)))
            page = pa.array(key // wide)
            yield pa.RecordBatch.from_arrays([own.column(0).take(page), own.column(1).take(page), pa.array(key % wide), pa.array((at[first] + 1).astype(np.int32)), lists, pa.array(np.full(len(key), len(sign), np.int32))], names=schema.names)

    return pages.select("asset_id", "page", "text").mapInArrow(run, schema)


def _split(batches: Iterator[pa.RecordBatch], sign: str) -> Iterator[tuple]:
    """Frames of asset_id, page and text, HELD bytes at a time, with their words: each one's row, number from 0, text, start and length."""
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // HELD
        for low, high in zip(*(np.searchsorted(held, np.unique(held), side).tolist() for side in ("left", "right"))):
            own = batch.slice(low, high - low)
            _, count, words = _lists(pc.split_pattern(own.column(2), sign))
            row, at = _spread(count)
            size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size + len(sign)) - size - len(sign)
            start -= np.repeat(start[(np.cumsum(count) - count)[count > 0]], count[count > 0])
            yield own, row, at, words, start, size


def time_ranges(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """JOIN9: first start and last end of the transcript lines that a passage covers."""
    c = chunks.select("asset_id", "chunk_order", F.col("start").alias("c_from"), (F.col("start") + F.length("content")).alias("c_to"))
    lines = lines.select("asset_id", "start_s", "end_s", F.col("char_offset").alias("l_from"), (F.col("char_offset") + F.length("text")).alias("l_to"))
    lines, c = _binned(lines, "l_from", "l_to", "l_bin"), _binned(c, "c_from", "c_to", "c_bin")
    own = c.join(lines, ["asset_id", "bin"]).where("l_from < c_to and l_to > c_from")  # met twice is no matter for least and greatest
    return own.groupBy("asset_id", "chunk_order").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def prices_for(models: DataFrame, prices: DataFrame) -> DataFrame:
    """JOIN10: an exact name's price, else that of the longest matching pattern with * ? and [ ]; every row of models stays.

    Distinct names are looked up: by equality first, and only those without an exact price meet the patterns. A pattern is
    found by what stands before its first wildcard, among a name's beginnings of the lengths that patterns have: an equality
    join, whose few hits are then matched. Patterns that open with a wildcard share the empty beginning.
    """
    names, prices = models.select("model_id").distinct(), prices.dropDuplicates(["pattern"])
    pattern = F.col("pattern")
    exact = names.join(prices, F.col("model_id") == pattern)
    escaped = F.regexp_replace(pattern, r"([.+^${}()|\\])", r"\\$1")
    wild = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"\[!", "[^"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    begin = F.regexp_extract(pattern, r"^[^*?\[]*", 0)
    patterns = prices.where(pattern.rlike(r"[*?\[]")).withColumns({"_wild": wild, "_begin": begin})
    lengths = [r[0] for r in patterns.select(F.length("_begin")).distinct().collect()]  # at most as many as a pattern is long
    rest = names.join(exact.select("model_id"), "model_id", "left_anti")
    begins = F.array(*(F.when(F.length("model_id") >= n, F.col("model_id").substr(1, n)) for n in sorted(lengths))) if lengths else F.array().cast("array<string>")
    keyed = rest.select("model_id", F.explode(F.filter(begins, lambda b: b.isNotNull())).alias("_begin"))
    hits = keyed.join(patterns, "_begin").where(F.rlike("model_id", F.col("_wild")))
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc(F.length(pattern)), pattern))
    return models.join(exact.unionByName(hits.withColumn("_n", rank).where("_n = 1").drop("_n", "_wild", "_begin")), "model_id", "left")


def caption_lines(figures: DataFrame, lines: DataFrame, most_gap: float = 60.0) -> DataFrame:
    """JOIN11: the printed line nearest to a figure; one that reads like a caption is preferred by half its gap."""
    pairs = figures.join(lines, ["asset_id", "page"])
    gap = F.when(F.col("ly0") >= F.col("fy1"), F.col("ly0") - F.col("fy1")).when(F.col("ly1") <= F.col("fy0"), F.col("fy0") - F.col("ly1")).otherwise(0.0)
    near = pairs.withColumn("gap", gap).where(F.col("gap") <= most_gap)
    caption = F.size(labels_in(F.col("line"))) > 0
    order = F.row_number().over(Window.partitionBy("asset_id", "page", "figure").orderBy(F.desc(caption), "gap", F.desc(F.col("ly0") >= F.col("fy1")), "line_no"))
    return near.withColumn("_n", order).where("_n = 1").drop("_n")


def lines_of_words(words: DataFrame) -> DataFrame:
    """AGG21: words joined to lines, with the line's box."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ")
    return words.groupBy("asset_id", "page", "block", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def highlight_rects(words: DataFrame) -> DataFrame:
    """AGG20: a box for each unbroken run of a passage's words on a line; none at all where there are too many."""
    island = F.col("word_no") - F.row_number().over(Window.partitionBy("asset_id", "page", "chunk_order", "block", "line").orderBy("word_no"))
    runs = words.withColumn("island", island).groupBy("asset_id", "page", "chunk_order", "block", "line", "island").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    n = F.count(F.lit(1)).over(Window.partitionBy("asset_id", "page", "chunk_order"))
    return runs.withColumn("_n", n).where(F.col("_n") <= MOST_RECTS).drop("_n", "island")


def reread_pages(pages: DataFrame, again: DataFrame) -> DataFrame:
    """JOIN22: pages that were read again take the new text and lose their word boxes."""
    new = again.select("asset_id", "page", F.col("text").alias("_new"))
    both = pages.join(new, ["asset_id", "page"], "left")
    return both.withColumns({"text": F.coalesce("_new", "text"), "words": F.when(F.col("_new").isNotNull(), F.array().cast(pages.schema["words"].dataType)).otherwise(F.col("words"))}).drop("_new")


def paired_pages(damaged: DataFrame, corrected: DataFrame) -> DataFrame:
    """JOIN20: the same page of both readings."""
    return damaged.withColumnRenamed("text", "damaged").join(corrected.withColumnRenamed("text", "corrected"), ["doc_id", "page"])
