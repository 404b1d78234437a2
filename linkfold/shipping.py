"""Makes this package importable in Python workers of a session that was started without it on its path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

import linkfold

_shipped: set[str] = set()


def ship_package(spark) -> None:
    """Add the package to the session's Python files, once per application, unless ``PYTHONPATH`` has it.

    The driver keeps the archive (a few dozen KB) until it ends and Spark sends it to the executors, which read nothing
    from the driver's folders.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(linkfold.__file__)))
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    build = tempfile.mkdtemp(prefix="linkfold-ship-")
    atexit.register(shutil.rmtree, build, ignore_errors=True)
    shutil.copytree(os.path.join(root, "linkfold"), os.path.join(build, "src", "linkfold"),
                    ignore=shutil.ignore_patterns("__pycache__"))
    archive = shutil.make_archive(os.path.join(build, "linkfold-src"), "zip", os.path.join(build, "src"))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
