import struct

from siftwork.sources import images as I


def test_sizes(spark, tmp_path):
    files = {
        "a.png": b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02",
        "b.jpg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 6,
        "c.pdf": b"%PDF-1.5 /MediaBox [0 0 612 792]",
        "d.eps": b"%!PS\n%%BoundingBox: 10 10 110 60\n",
        "e.txt": b"text",
        "f.png": b"\x89PNG\r\n\x1a\n",
        "g.jpg": b"\xff\xd8",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[-1]: (r["kind"], r["width"], r["height"]) for r in I.images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 640, 480), "b.jpg": ("jpeg", 40, 30), "c.pdf": ("pdf", 612, 792), "d.eps": ("eps", 100, 50), "e.txt": ("unknown", None, None), "f.png": ("png", None, None), "g.jpg": ("jpeg", None, None)}
