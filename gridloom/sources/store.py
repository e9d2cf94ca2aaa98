"""Where rasters lie: local paths and object stores, their options, and reading byte ranges."""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from gridloom.errors import ArgumentError, SourceError

# Virtual path prefixes and the options that each kind of store takes.
VIRTUAL = {"/vsis3/": "s3://", "/vsigs/": "gs://", "/vsiaz/": "az://", "/vsicurl/": "", "/vsicurl_streaming/": ""}
KINDS = {"s3": "s3", "s3a": "s3", "gs": "gs", "az": "az", "abfs": "az", "http": "http", "https": "http", "file": "local", "": "local"}
OPTIONS = {
    "s3": {"region", "endpoint", "access_key_id", "secret_access_key", "session_token", "skip_signature", "profile", "virtual_hosted_style_request", "request_payer", "allow_http"},
    "gs": {"service_account", "service_account_path", "service_account_key", "skip_signature"},
    "az": {"account_name", "account_key", "sas_token", "endpoint", "skip_signature"},
    "http": {"timeout", "user_agent", "allow_http", "default_headers"},
    "local": set(),
}
SECRET = re.compile(r"key|token|secret|sas|account$|headers", re.I)


def resolve(path: str) -> str:
    """A virtual path as its URL; other paths unchanged."""
    for prefix, scheme in VIRTUAL.items():
        if path.startswith(prefix):
            return scheme + path[len(prefix) :]
    if path.startswith("/vsi"):
        raise SourceError(f"the virtual path {path} is not supported")
    return path


def kind_of(path: str) -> str:
    scheme = urlparse(resolve(path)).scheme.lower()
    if scheme not in KINDS:
        raise SourceError(f"no store is known for {scheme}://")
    return KINDS[scheme]


def check_options(path: str, options: dict | None) -> dict[str, str]:
    """Options as text; unknown ones, and any on a local path, are errors."""
    kind, out = kind_of(path), {}
    for k, v in (options or {}).items():
        if not isinstance(k, str) or not k or isinstance(v, (list, dict, tuple)) or v is None:
            raise ArgumentError("store options are named single values")
        if k not in OPTIONS[kind]:
            raise ArgumentError(f"{k} is not an option of {'local paths' if kind == 'local' else kind}")
        out[k] = str(v).lower() if isinstance(v, bool) else str(v)
    return out


def store_config(path: str, options: dict | None = None) -> dict[str, str]:
    """What a read of path would use. Secrets are never shown, only that they are set."""
    url, kind = resolve(path), kind_of(path)
    given = check_options(path, options)
    out = {"kind": kind, "url": url}
    if kind == "s3":
        host = urlparse(url)
        out["bucket"] = host.netloc
        out["region"] = given.get("region") or os.environ.get("AWS_REGION") or os.environ.get("AWS_DEFAULT_REGION") or "us-east-1"
        signed = "access_key_id" in given or "AWS_ACCESS_KEY_ID" in os.environ or "profile" in given
        out["signed"] = str(signed and given.get("skip_signature") != "true").lower()
    for k, v in given.items():
        out[k] = "<set>" if SECRET.search(k) else v
    return out


class Ranges:
    """Byte ranges of one file; local files are read in place, others through fsspec where it is installed."""

    def __init__(self, path: str, options: dict | None = None):
        self.path = resolve(path)
        if kind_of(path) == "local":
            try:
                self.file = open(self.path.removeprefix("file://"), "rb")
            except OSError as e:
                raise SourceError(f"cannot open {path}: {e.strerror}") from e
        else:
            try:
                import fsspec
            except ImportError as e:
                raise SourceError("reading object stores needs fsspec and the store's filesystem") from e
            self.file = fsspec.open(self.path, "rb", **(options or {})).open()

    def whole(self) -> bytes:
        self.file.seek(0)
        return self.file.read()

    def get(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def close(self) -> None:
        self.file.close()


def coalesce(ranges: list[tuple[int, int]], gap: int = 1 << 20, most: int = 2 << 20) -> list[tuple[int, int]]:
    """Ranges (offset, size) at most `gap` apart merged into requests of at most `most` bytes, unless one alone is larger."""
    out: list[tuple[int, int]] = []
    for offset, size in sorted(ranges):
        if out:
            a, n = out[-1]
            end = max(a + n, offset + size)
            if offset - (a + n) <= gap and end - a <= most:
                out[-1] = (a, end - a)
                continue
        out.append((offset, size))
    return out
