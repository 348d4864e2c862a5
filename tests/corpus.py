"""A small source tree with hand-labelled facts."""

FILES = {
    "src/__init__.py": "",
    "src/store/__init__.py": "",
    "src/store/box.py": '''LIMIT = 3
__all__ = ["Box", "pack"]


class Box:
    def open(self, key):
        return _check(key)


def pack(item, size=LIMIT):
    return Box().open(item)


def _check(key):
    return bool(key)


def _unused(key):
    return key
''',
    "src/app/orders.py": '''from src.store.box import pack
from src.store import box as crate
import json, os.path as osp


def order(item):
    return pack(item, 2)


def reorder(item):
    return crate.pack(item)


def label(item):
    return json.dumps(item.open("x"))
''',
    "src/app/alias.py": '''from ..store.box import pack as wrap


def wrapped(item):
    return wrap(item)
''',
    "src/lookup.py": '''from src.store import box

NAMES = {"pack": "pack"}


def call(name, item):
    handler = getattr(box, NAMES[name])
    return handler(item)


def direct(item):
    return getattr(box, "pack")(item)
''',
    "src/broken.py": "def oops(:\n",
    "tests/test_box.py": '''from src.store.box import pack
from src.app.orders import order


def test_pack():
    assert pack("a")


def test_order():
    assert order("a")
''',
    "node_modules/skip.py": "def never(): pass\n",
    "README.md": "text",
}

TRUTH = [
    ("src/app/orders.py", 7, True), ("src/app/orders.py", 11, True), ("src/app/alias.py", 5, True),
    ("src/lookup.py", 8, False), ("src/lookup.py", 12, False),
]


def write(root) -> str:
    for name, body in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    return str(root)
