"""A database and a file store that fail twice at each read, then work; the marks lie in a folder."""

import hashlib
import os
import sqlite3

from pyarrow import fs


def stumble(folder, what, times=2, said="server closed the connection unexpectedly"):
    mark = os.path.join(folder, hashlib.md5(repr(what).encode()).hexdigest())
    for k in range(times):
        try:
            os.close(os.open(f"{mark}-{k}", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            continue
        raise OSError(said)


class Cursor:
    def __init__(self, options, cursor):
        self.options, self.cursor = options, cursor

    def execute(self, sql, values):
        with open(os.path.join(self.options["marks"], "sql.log"), "a") as f:
            f.write(sql + "\n")
        if "limit" in sql:
            stumble(self.options["marks"], (sql, values), said=self.options.get("said", "SSL SYSCALL error: EOF detected"))
        self.cursor.execute(sql, values)

    def fetchall(self):
        return self.cursor.fetchall()


class Connection:
    def __init__(self, options):
        self.options, self.own = options, sqlite3.connect(options["file"])

    def cursor(self):
        return Cursor(self.options, self.own.cursor())

    def close(self):
        self.own.close()


def connect(options):
    return Connection(options)


class Handler(fs.FileSystemHandler):
    """The local store, whose first two readings of a file fail."""

    def __init__(self, marks):
        self.marks, self.own = marks, fs.LocalFileSystem()

    def __getattribute__(self, name):
        return object.__getattribute__(self, name)

    def get_type_name(self):
        return "flaky"

    def get_file_info(self, paths):
        return self.own.get_file_info(paths)

    def get_file_info_selector(self, selector):
        return self.own.get_file_info(selector)

    def open_input_stream(self, path):
        stumble(self.marks, path)
        return self.own.open_input_stream(path)

    def open_input_file(self, path):
        return self.own.open_input_file(path)

    def normalize_path(self, path):
        return path

    def _no(self, *_, **__):
        raise NotImplementedError

    create_dir = delete_dir = delete_dir_contents = delete_root_dir_contents = delete_file = move = copy_file = open_output_stream = open_append_stream = _no


def store(options):
    return fs.PyFileSystem(Handler(options["marks"]))
