import zipfile

from vellumite.sources import archives


def put(folder, name, **members):
    with zipfile.ZipFile(f"{folder}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
        for path, content in members.get("members", {}).items():
            z.writestr(path, content)
    return f"file://{folder}/{name}"


def test_from_archives_to_entries(spark, tmp_path):
    text = 'see ![x](img/a.png) and <img class="c" src="../b.png"> but ![y](https://h/c.png) and ![z](../../out.png)'
    one = put(tmp_path, "1.zip", members={"auto/full.md": text, "notes.md": "# no", "deep/er/layout.json": "{}", "auto/layout.json": "{}", "__MACOSX/full.md": "no", "../out.md": "no", "a/": ""})
    two, three = put(tmp_path, "2.zip", members={"a.txt": "x"}), put(tmp_path, "3.zip", members={"x.md": "short"})
    raw = (tmp_path / "3.zip").read_bytes()
    (tmp_path / "4.zip").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "5.zip").write_bytes(b"")
    (tmp_path / "6.zip").write_bytes(raw.replace(b"short"[:3], b"SHO") if b"sho" in raw else raw[:40] + b"\xff" + raw[41:])
    rows = [(1, one), (2, two), (3, three), (4, f"file://{tmp_path}/4.zip"), (5, f"file://{tmp_path}/5.zip"), (6, f"file://{tmp_path}/6.zip"), (7, f"file://{tmp_path}/none.zip"), (8, None)]
    found = {r.doc_id: r for r in archives.entries(spark.createDataFrame(rows, "doc_id long, archive string")).collect()}
    assert found[1].markdown == 'see ![x](/api/media/1/auto/img/a.png) and <img class="c" src="/api/media/1/b.png"> but ![y](https://h/c.png) and ![z](../../out.png)'
    assert (found[1].state, found[1].path, found[1].layout) == ("done", "auto/full.md", "/api/media/1/auto/layout.json")
    assert (found[2].state, found[2].error) == ("failed", archives.NO_MARKDOWN) and (found[3].state, found[3].markdown, found[3].layout) == ("done", "short", None)
    assert {(found[k].state, found[k].error) for k in (4, 5, 6, 7)} == {("failed", archives.NOT_READ)} and (found[8].state, found[8].error) == ("pending", None)


def test_members_in_parts(spark, tmp_path):
    """A member far larger than a part comes in parts that give it again; texts are not cut within a letter."""
    text = "é😀x" * 50_000
    uri = put(tmp_path, "a.zip", members={"big.md": text, "empty.md": ""})
    found = archives.directory(spark.createDataFrame([(1, uri)], "doc_id long, archive string"))
    assert sorted((r.path, r.size) for r in found.collect()) == [("big.md", len(text.encode())), ("empty.md", 0)]
    some = sorted((r.path, r.part, bytes(r.content)) for r in archives.parts(found, 10_000).collect())
    assert max(len(c) for *_, c in some) <= 10_000 and b"".join(c for p, _, c in some if p == "big.md").decode() == text and ("empty.md", 0, b"") in some
    assert {r.path: r.text for r in archives.texts(found).collect()} == {"big.md": text, "empty.md": ""}


def test_no_archives(spark):
    assert archives.entries(spark.createDataFrame([], "doc_id long, archive string")).count() == 0
