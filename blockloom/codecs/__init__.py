"""Container codecs. Each takes a container apart into meta and decompressed parts, and puts it together again, byte for
byte; what it could not rebuild exactly it refuses to open (None), and the container stays a blob."""

from __future__ import annotations

from ..model import ContainerFormat
from . import cab, zip


def codec_of(fmt: int):
    """Codecs that tasks can run; 7z needs the JVM and runs on the driver (codecs.sevenz)."""
    return {ContainerFormat.ZIP: zip, ContainerFormat.CAB: cab}[ContainerFormat(fmt)]
