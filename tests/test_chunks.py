"""Chunks of lessons of several pages, against a plain loop."""

from collections import defaultdict

import pytest

from foliant.operators import books as B


def plain(pages, limit):
    """(book, lesson, index, global index, section, pages, body) by the reference's loop."""
    out, books = [], defaultdict(lambda: defaultdict(list))
    for order, book, lesson, number, text in sorted(pages):
        books[book][lesson].append((number, text))
    for book, lessons in books.items():
        n = 0
        for lesson, rows in lessons.items():
            blocks = [[f"T {lesson}", [], set()]]
            for number, text in rows:
                for line in filter(None, map(str.strip, text.splitlines())):
                    if line.startswith("Bài "):
                        blocks.append([line, [], set()])
                    blocks[-1][1].append(line)
                    blocks[-1][2].add(number)
                blocks[-1][1].append("")
            index = 0
            for section, lines, numbers in blocks:
                text, parts, held = "\n".join(lines).strip(), [], []
                for line in text.split("\n"):
                    if held and len(text) > limit and sum(len(x) + 1 for x in held) + len(line) + 1 > limit:
                        parts.append(held)
                        held = []
                    held.append(line)
                for part in filter(None, ("\n".join(x).strip() for x in [*parts, held])):
                    index, n = index + 1, n + 1
                    label = f"{min(numbers)}-{max(numbers)}" if len(numbers) > 1 else str(min(numbers))
                    out.append((book, lesson, index, n, section, label, part))
    return sorted(out)


@pytest.mark.parametrize("run", [65_536, 2])
def test_blocks_cross_pages_and_indexes_run_on(spark, monkeypatch, run):
    monkeypatch.setattr(B, "RUN", run)
    texts = ["start\n\n  of it \nBài 1 one\na b c", "goes on here\nand on", "", " \n ", "Bài 2 two\r\nx\nBài 3 three\n" + "long line of words\n" * 6, "end"]
    pages = [(i, f"b{i % 2}", f"l{i // 12 if i < 36 else 0}", 7 + i // 2, texts[i % 5 if i % 7 else 5]) for i in range(44)]
    df = spark.createDataFrame(pages, "doc_id long, source string, lesson_id string, page_number int, text string").selectExpr("*", "concat('T ', lesson_id) AS title")
    rows = B.chunks(B.lesson_blocks(df, ["source", "lesson_id"], "doc_id", "title"), "source", "lesson_id", "title", 60).collect()
    got = sorted((r.source, r.lesson_id, r.chunk_index, r.global_chunk_index, r.section, r.source_pages, r.markdown_content.split(" -->\n\n", 1)[1]) for r in rows)
    assert got == plain(pages, 60)
    assert len({r.chunk_id for r in rows}) == len(rows) and any("-" in r.source_pages for r in rows)
