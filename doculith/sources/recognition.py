"""Recognition of page images in small batches; only the recogniser itself is an interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pages of a batch, and what stands between the pages of a document's text.
BATCH = 5
PAGE_BREAK = "\n---\n"
#: Takes the images of some pages and returns their texts, as many.
Recogniser = Callable[[list[bytes]], list[str]]


def recognise(pages: DataFrame, recogniser: Recogniser, *keys: str, page: str = "page", image: str = "image", batch: int = BATCH, method: str = "ocr") -> DataFrame:
    """(keys, page, text, method, error): the text of each page image, in batches of at most `batch` pages of a document.

    Batches, not documents, are what is dealt out, so that a document of any number of pages spreads, and a task holds
    the images of one batch. If a batch fails, its pages are tried one by one; a page that fails, or has no image, has an
    empty text and an error, and fails alone. Pages without a number make up a batch of their own kind.
    """
    rows = pages.select(*keys, F.col(page).cast("int").alias("page"), F.col(image).alias("image"))
    rows = rows.withColumn("_batch", F.floor((F.coalesce("page", F.lit(-1)) - 1) / batch))
    dealt = rows.repartition(*keys, "_batch").sortWithinPartitions(*keys, "_batch", "page")
    number, picture, group = len(keys), len(keys) + 1, len(keys) + 2
    shape = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "page int, text string, method string, error string"])

    def one(data: bytes | None) -> tuple[str, str | None]:
        if data is None:
            return "", "no image"
        try:
            return recogniser([data])[0] or "", None
        except Exception as e:  # noqa: BLE001  whatever a recogniser raises ends its page alone
            return "", f"{type(e).__name__}: {e}"

    def read(images: list[bytes | None]) -> list[tuple[str, str | None]]:
        whole = [i for i in images if i is not None]
        if whole:
            try:
                texts = recogniser(whole)
                if len(texts) == len(whole):
                    found = iter(texts)
                    return [("", "no image") if i is None else (next(found) or "", None) for i in images]
            except Exception:  # noqa: BLE001
                pass
        return [one(i) for i in images]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            for b in [pa.Table.from_batches(held).combine_chunks().to_batches()[0]] if held else []:
                for i in range(0, len(b), batch):
                    part = b.slice(i, batch)
                    found = read(part.column(picture).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[: number + 1], pa.array([t for t, _ in found], pa.string()), pa.array([method] * len(found)), pa.array([e for _, e in found], pa.string())], names=[*keys, "page", "text", "method", "error"])

        for b in batches:
            for i in range(len(b)):
                key = tuple(b.column(k)[i].as_py() for k in (*range(number), group))
                if held and (key != last or len(held) >= batch):
                    yield from flush()
                    held = []
                held.append(b.slice(i, 1))
                last = key
        yield from flush()

    return dealt.mapInArrow(run, shape)


def documents(recognised: DataFrame, *keys: str) -> DataFrame:
    """(keys, text, pages, failed_pages): the pages of each document in their order, with a break between two of them."""
    page = F.struct("page", "text", F.col("error").isNotNull().alias("failed"))
    rows = recognised.groupBy(*keys).agg(F.array_sort(F.collect_list(page)).alias("p"))
    return rows.select(*keys, F.array_join(F.transform("p", lambda x: x["text"]), PAGE_BREAK).alias("text"), F.size("p").alias("pages"), F.size(F.filter("p", lambda x: x["failed"])).alias("failed_pages"))
