"""Small objects in a store, through Hadoop's file systems: each is there whole or not at all, and its name is taken once."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Fixed value: what a store that can put an object on the condition that there is none calls that.
_CONDITIONAL_PUT = "fs.option.create.conditional.overwrite"


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _file_system(spark, path)
    return files.exists(hadoop)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there. Names that begin with a dot are not listed."""
    files, hadoop = _file_system(spark, folder)
    if not files.exists(hadoop):
        return []
    names = [status.getPath().getName() for status in files.listStatus(hadoop)]
    return sorted(name for name in names if not name.startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    """A whole object; what is not UTF-8 in it is replaced."""
    files, hadoop = _file_system(spark, path)
    stream = files.open(hadoop)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode(errors="replace")
    finally:
        stream.close()


def _write(stream: JavaObject, text: str) -> None:
    try:
        stream.write(bytearray(text.encode()))
        stream.hsync()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Puts an object of that name unless there is one; whether it was put. Of writers that race, one puts.

    The text is written in full under a name of its own, and one step of the store then gives it the name: a hard link
    in a local file system, a rename that never overwrites elsewhere. A writer that is lost before that leaves
    nothing under the name. Stores that put an object whole, on the condition that there is none, do so at once.
    """
    files, hadoop = _file_system(spark, path)
    parent, jvm = hadoop.getParent(), spark._jvm
    files.mkdirs(parent)
    if files.hasPathCapability(hadoop, _CONDITIONAL_PUT):
        return _put_on_condition(files, hadoop, text)
    staged = jvm.org.apache.hadoop.fs.Path(parent, f".{hadoop.getName()}.{uuid.uuid4().hex}")
    _write(files.create(staged, False), text)
    try:
        if files.getUri().getScheme() == "file":
            own, named = (files.pathToFile(p).toPath() for p in (staged, hadoop))
            jvm.java.nio.file.Files.createLink(named, own)
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            never = spark.sparkContext._gateway.new_array(rename, 1)
            never[0] = rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(staged, hadoop, never)
        return True
    except Py4JJavaError:
        if files.exists(hadoop):
            return False
        raise
    finally:
        if files.exists(staged):
            files.delete(staged, False)


def _put_on_condition(files: JavaObject, hadoop: JavaObject, text: str) -> bool:
    try:
        _write(files.createFile(hadoop).overwrite(False).must(_CONDITIONAL_PUT, True).build(), text)
        return True
    except Py4JJavaError:
        if files.exists(hadoop):
            return False
        raise
