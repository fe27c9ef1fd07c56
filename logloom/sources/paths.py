"""Where bytes come from: local files, stores that Arrow reads, files of other hosts over the ssh program."""

from __future__ import annotations

import atexit
import os
import shlex
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote, urlsplit


@dataclass(frozen=True)
class SshSource:
    user: str
    host: str
    path: str
    port: int = 22

    def command(self, remote: str) -> list[str]:
        """The ssh program's arguments. KEY names a file of a private key; a password (or that of the key) in PASSWORD is handed over by ASKPASS."""
        key = ["-i", os.environ[KEY], "-o", "IdentitiesOnly=yes"] if os.environ.get(KEY) else []
        batch = [] if os.environ.get(PASSWORD) else ["-o", "BatchMode=yes"]
        return ["ssh", *batch, *key, "-p", str(self.port), f"{self.user}@{self.host}", remote]


#: Names in the environment of whoever reads: on a cluster, spark.executorEnv.<name> sets them. They are no options, as those appear in plans.
KEY, PASSWORD = "LOGLOOM_SSH_KEY", "LOGLOOM_SSH_PASSWORD"


@lru_cache(maxsize=1)
def _askpass() -> str:
    """A script of this process's own that prints the password from its environment; it holds no secret itself."""
    handle, script = tempfile.mkstemp(prefix="askpass-")
    with os.fdopen(handle, "w") as f:
        f.write(f"#!/bin/sh\nprintf '%s\\n' \"${PASSWORD}\"\n")
    os.chmod(script, 0o700)
    atexit.register(lambda: os.path.exists(script) and os.unlink(script))
    return script


def _environment() -> dict[str, str]:
    """The environment of an ssh program: with a password set, that asks a script for it."""
    if not os.environ.get(PASSWORD):
        return dict(os.environ)
    return os.environ | {"SSH_ASKPASS": _askpass(), "SSH_ASKPASS_REQUIRE": "force", "DISPLAY": os.environ.get("DISPLAY", ":0")}


def parse_ssh(url: str) -> SshSource:
    """ssh://user@host[:port]/path; what is missing is named in the error."""
    parts = urlsplit(url)
    if parts.scheme != "ssh":
        raise ValueError(f"not an ssh:// address: {url}")
    if not parts.username:
        raise ValueError(f"user is missing in {url}")
    if not parts.hostname:
        raise ValueError(f"host is missing in {url}")
    if not parts.path or parts.path == "/":
        raise ValueError(f"path is missing in {url}")
    return SshSource(unquote(parts.username), parts.hostname, unquote(parts.path), parts.port or 22)


class Bytes:
    """A file's bytes by range; opened anew wherever it is read, so that tasks share nothing."""

    def __init__(self, path: str):
        self.path = path

    def _arrow(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    @property
    def local(self) -> str | None:
        return self.path.removeprefix("file://") if "://" not in self.path or self.path.startswith("file://") else None

    def size(self) -> int:
        if self.path.startswith("ssh://"):
            s = parse_ssh(self.path)
            return int(subprocess.run(s.command(f"wc -c < {shlex.quote(s.path)}"), check=True, capture_output=True, env=_environment()).stdout)
        if self.local is not None:
            return os.stat(self.local).st_size
        system, path = self._arrow()
        return system.get_file_info(path).size

    def __call__(self, start: int, length: int) -> bytes:
        """length bytes from start, or fewer at the end; short reads are continued."""
        if length <= 0:
            return b""
        if self.path.startswith("ssh://"):
            s = parse_ssh(self.path)
            return subprocess.run(s.command(f"tail -c +{start + 1} {shlex.quote(s.path)} | head -c {length}"), check=True, capture_output=True, env=_environment()).stdout
        if self.local is not None:
            with open(self.local, "rb") as f:
                f.seek(start)
                return read_fully(f, length)
        system, path = self._arrow()
        with system.open_input_file(path) as f:
            f.seek(start)
            return read_fully(f, length)


def read_fully(f, length: int) -> bytes:
    out = []
    while length > 0 and (piece := f.read(length)):
        out.append(piece)
        length -= len(piece)
    return b"".join(out)


def ssh_stream(url: str, cmd: str | None = None) -> Iterator[bytes]:
    """What a command prints on the other host (by default, the file itself), as it comes; .zst is unpacked on the way."""
    import zstandard

    s = parse_ssh(url)
    run = subprocess.Popen(s.command(cmd or f"cat {shlex.quote(s.path)}"), stdout=subprocess.PIPE, env=_environment())
    stream = zstandard.ZstdDecompressor().stream_reader(run.stdout, read_across_frames=True) if s.path.endswith(".zst") and not cmd else run.stdout
    while piece := stream.read(1 << 16):
        yield piece
    if run.wait():
        raise OSError(f"ssh ended with {run.returncode}")


def lines_of(pieces: Iterator[bytes]) -> Iterator[str]:
    """Lines, each with its newline, if it has one."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from (w.decode("utf-8", "replace") + "\n" for w in whole)
    if rest:
        yield rest.decode("utf-8", "replace")
