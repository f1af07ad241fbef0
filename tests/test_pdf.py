import zlib

from paperloom.sources import pdf as D


def build(pages, pack=zlib.compress, extra=b""):
    """A PDF of text pages: lines of one size under each other, a page tree of two levels."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count %d >>" % len(pages), None, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for lines in pages:
        body = b"BT /F1 12 Tf 14 TL 72 720 Td " + b" ".join(b"(%s) Tj T*" % t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for t in lines) + b" ET"
        body = pack(body)
        objects.append(b"<< /Length %d %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if pack is zlib.compress else b"") + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 3 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[2] = b"<< /Type /Pages /Parent 2 0 R /Resources << /Font << /F1 4 0 R >> >> /Kids [" + b" ".join(kids) + b"] >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, o) for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R " + extra + b" >>\n%%EOF"


def test_pages():
    pages = [["Halaman (satu)", "baris dua: naïve – ok"], [], ["a\\b"]]
    want = ["Halaman (satu)\nbaris dua: naïve – ok", "", "a\\b"]
    assert D.page_texts(build(pages)) == want and D.page_texts(build(pages, pack=bytes)) == want
    assert D.page_texts(b"no pdf") == [] and D.page_texts(build(pages, extra=b"/Encrypt 9 0 R")) == []
    assert D.page_texts(build(pages)[:200]) == []


def test_unicode_fonts_and_spacing():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    body = b"BT /F1 10 Tf 1 0 0 1 50 700 Tm [<00010010> -400 <0011>] TJ 1 0 0 1 50 650 Tm <0012> Tj 1 0 0 1 200 650.5 Tm <0001> Tj ET"
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]>>", b"<</Type/Page/Contents[6 0 R]/Resources<</Font<</F1 4 0 R>>>>>>", b"<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>"]
    parts += [b"<</Length %d>>\nstream\n%s\nendstream" % (len(s), s) for s in (cmap, body)]
    data = b"%PDF-1.7\n" + b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate(parts, 1)) + b"trailer<</Root 1 0 R>>"
    assert D.page_texts(data) == ["Aa b\nc A"]


def test_compressed_objects():
    held = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]>>"), (3, b"<</Type/Page/Contents 6 0 R>>")]
    body, heads = b"", b""
    for n, o in held:
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    packed = zlib.compress(heads + body)
    text = zlib.compress(b"BT /F1 9 Tf 10 10 Td (isi) ' ET")
    data = b"%%PDF-1.5\n5 0 obj <</Type/ObjStm/N 3/First %d/Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream endobj\n" % (len(heads), len(packed), packed)
    data += b"6 0 obj <</Filter[/FlateDecode]/Length %d>>\nstream\n%s\nendstream endobj\n7 0 obj <</Type/XRef/Root 1 0 R/Length 0>>\nstream\n\nendstream endobj" % (len(text), text)
    assert D.page_texts(data) == ["isi"]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build([["satu"], ["dua"]]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken (((")
    pages = D.read_pdf_text(spark, tmp_path.as_uri())
    assert {(r["path"].rpartition("/")[2], r["page_number"], r["text"]) for r in pages.collect()} == {("a.pdf", 1, "satu"), ("a.pdf", 2, "dua")}
    assert [r["n_pages"] for r in D.page_counts(pages).collect()] == [2]
