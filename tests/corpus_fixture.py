"""A small source corpus written to a temporary folder by the tests.

Covers: nested and async functions, a module-level function after a class,
the same name in two modules, a built-in call, self and mutual recursion,
dotted / called / odd decorators, tuple and dotted exception handlers, an
unparseable file, and excluded ``tests/`` / ``test_*.py`` files.
"""

FILES = {
    "pkg/core.py": '''import os
from typing import List


class Service:
    def start(self):
        return helper(1)


def helper(x):
    print(x)
    return os.path.join("a", str(x))


def outer():
    def inner():
        return helper(2)
    return inner()


async def fetch(url):
    try:
        return await get(url)
    except (ValueError, KeyError):
        return None
    except os.error:
        return None
    except TimeoutError:
        return None
''',
    "pkg/util.py": '''import functools


def helper(y):
    return y


@functools.lru_cache(maxsize=8)
def fact(n):
    return 1 if n <= 1 else n * fact(n - 1)


@staticmethod
def ping():
    return pong()


@registry["x"]
def pong():
    return ping()


def get(url):
    return url
''',
    "pkg/broken.py": "def oops(:\n    pass\n",
    "tests/test_core.py": "def test_x():\n    assert True\n",
    "pkg/test_util.py": "def test_y():\n    assert True\n",
    "pkg/sub/test/mod.py": "def hidden():\n    return 1\n",
    "pkg/sub/tests_helpers.py": "def visible():\n    return 1\n",
}


def write(root):
    import os
    for rel, text in FILES.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)
    return root
