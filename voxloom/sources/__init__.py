"""Scans and sinks."""

from voxloom.sources.readers import *  # noqa: F401,F403
from voxloom.sources.sealed import *  # noqa: F401,F403
from voxloom.sources.sinks import *  # noqa: F401,F403
