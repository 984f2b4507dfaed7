"""Images of documents: spans, one caption for each distinct image, splicing in order."""

import hashlib
import io
import re
import zipfile

from pyspark.sql import functions as F

from quernstone.sources import images, loaders

PNG, GIF = b"\x89PNG one", b"GIF two"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def block(text):
    return f"\n<image_description>\n{text}\n</image_description>\n"


def test_every_image_gets_its_own_caption(spark):
    texts = ["a ![x](http://h/1.png) b ![y](https://h/2.png)c", "![z](http://h/1.png)![n](http://h/none.png)", "no ![l](local.png)", None, "", "![](http://h/2.png)", "$1 \\ ![q](http://h/$2.png)"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, link string")
    caption = lambda link: F.when(~F.contains(link, F.lit("none")), F.concat(F.lit("of $"), link))
    got = {r.id: r for r in images.caption_images(docs, caption=caption).collect()}
    one, two = block("of $http://h/1.png"), block("of $https://h/2.png")
    assert got[0].text == f"a {one} b {two}c" and got[0].link == "kept"
    assert got[1].text == f"{one}n"
    assert (got[2].text, got[3].text, got[4].text) == (texts[2], None, "")
    assert got[5].text == block("of $http://h/2.png") and got[6].text == f"$1 \\ {block('of $http://h/$2.png')}"
    assert len(got) == 7


def test_an_image_is_captioned_once_for_the_corpus(spark):
    docs = spark.createDataFrame([(i, "![a](http://h/same.png) and ![b](http://h/same.png)") for i in range(50)], "id int, text string").repartition(4)
    texts = [r.text for r in images.caption_images(docs, caption=lambda link: F.concat(link, F.uuid())).collect()]
    assert len({said for t in texts for said in re.findall(r"same\.png([0-9a-f-]{36})", t)}) == 1 and len(texts) == 50


def test_nobody_captions(spark):
    docs = spark.createDataFrame([(1, f"![alt](http://h/x.png) {images.mark_of(PNG)} {images.mark_of(GIF, 'chart')}")], "id int, text string")
    assert images.caption_images(docs).head().text == "alt <image> chart"
    assert images.caption_images(docs.limit(0)).count() == 0


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def rels(*pairs):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"/>' for i, kind, target in pairs) + "</Relationships>"


DOCX = office({
    "word/document.xml": f'<w:d xmlns:w="w" xmlns:a="a" xmlns:r="{REL}"><w:p><w:r><w:t>first</w:t></w:r><w:r><w:drawing><docPr descr="a [b]"/><a:blip r:embed="r2"/></w:drawing></w:r></w:p><w:p><w:drawing><a:blip r:embed="r1"/></w:drawing><w:drawing><a:blip r:embed="r9"/></w:drawing></w:p></w:d>',
    "word/_rels/document.xml.rels": rels(("r1", "image", "media/image1.png"), ("r2", "image", "media/image2.gif"), ("r9", "image", "media/gone.png")),
    "word/media/image1.png": PNG, "word/media/image2.gif": GIF,
})
SLIDE = f'<p:sld xmlns:p="p" xmlns:a="a" xmlns:c="c" xmlns:r="{REL}"><p:pic><a:blip r:embed="r1"/></p:pic><p:graphicFrame><c:chart r:id="r2"/></p:graphicFrame><p:sp><a:p><a:t>%s</a:t></a:p></p:sp></p:sld>'
CHART = '<c:chartSpace xmlns:c="c" xmlns:a="a"><c:chart><c:title><a:p><a:v>Sales</a:v></a:p></c:title><c:ser><c:tx><c:pt idx="0"><c:v>2023</c:v></c:pt></c:tx><c:cat><c:pt idx="0"><c:v>north</c:v></c:pt><c:pt idx="1"><c:v>south</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>1</c:v></c:pt><c:pt idx="1"><c:v>2.5</c:v></c:pt></c:val></c:ser><c:ser><c:tx><c:v>2024</c:v></c:tx><c:val><c:pt idx="1"><c:v>7</c:v></c:pt></c:val></c:ser></c:chart></c:chartSpace>'
PPTX = office({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{REL}"><p:sldId id="256" r:id="x2"/><p:sldId id="257" r:id="x1"/></p:presentation>',
    "ppt/_rels/presentation.xml.rels": rels(("x1", "slide", "slides/slide1.xml"), ("x2", "slide", "slides/slide2.xml")),
    "ppt/slides/slide1.xml": SLIDE % "second shown", "ppt/slides/slide2.xml": SLIDE % "first shown",
    "ppt/slides/_rels/slide1.xml.rels": rels(("r1", "image", "../media/image1.png")),
    "ppt/slides/_rels/slide2.xml.rels": rels(("r1", "image", "../media/image2.gif"), ("r2", "chart", "../charts/chart4.xml"), ("r3", "notesSlide", "../notesSlides/notesSlide9.xml")),
    "ppt/media/image1.png": PNG, "ppt/media/image2.gif": GIF, "ppt/charts/chart4.xml": CHART.replace("a:v>", "a:t>"), "ppt/notesSlides/notesSlide9.xml": '<p:n xmlns:p="p" xmlns:a="a"><a:t>said</a:t></p:n>',
})


def test_parsers_find_images_charts_and_notes():
    text, contents = loaders.parse_docx(DOCX)
    assert text == f"first\n{images.mark_of(GIF, 'a [b]')}\n{images.mark_of(PNG)}\n[PAGE_1]\n" and contents == [GIF, PNG]
    text, contents = loaders.parse_pptx(PPTX)
    table = "### Chart: Sales\n| Category | 2023 | 2024 |\n| --- | --- | --- |\n| north | 1 |  |\n| south | 2.5 | 7 |"
    assert text == f"{images.mark_of(GIF)}\n{table}\nfirst shown\n### Notes:\nsaid\n\n[PAGE_1]\n\n{images.mark_of(PNG)}\nsecond shown\n\n[PAGE_2]\n"
    assert contents == [GIF, PNG]


def test_loaded_files_with_captions(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.pptx").write_bytes(PPTX)
    (tmp_path / "c.md").write_text("x ![one](http://h/1.png) y ![two](http://h/2.png)")
    (tmp_path / "d.txt").write_text("![not](http://h/1.png)")
    (tmp_path / "e.docx").write_bytes(b"broken")
    files = loaders.scan_files(spark, str(tmp_path))
    said = lambda data: block(f"sha {hashlib.sha256(data).hexdigest()[:6]}")
    both = loaders.load_files(files, caption=lambda link: F.concat(F.lit("of "), link), caption_content=lambda c: F.concat(F.lit("sha "), F.substring(F.sha2(c, 256), 1, 6)))
    got = {r.file_id: r for r in both.collect()}
    assert got["a.docx"].text == f"first\n{said(GIF)}\n{said(PNG)}\n[PAGE_1]\n"
    assert got["b.pptx"].text.startswith(said(GIF)) and said(PNG) in got["b.pptx"].text
    assert got["c.md"].text == f"x {block('of http://h/1.png')} y {block('of http://h/2.png')}"
    assert got["d.txt"].text == "![not](http://h/1.png)" and got["e.docx"].text is None and got["e.docx"].error
    plain = {r.file_id: r.text for r in loaders.load_files(files).collect()}
    assert plain["a.docx"] == "first\na [b \n<image>\n[PAGE_1]\n" and plain["c.md"].startswith("x ![one]") and set(both.columns) == set(loaders.load_files(files).columns)
