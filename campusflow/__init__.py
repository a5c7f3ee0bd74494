"""campusflow: academy analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Every operator takes DataFrames (plus plain parameters such as ``as_of``) and
returns a lazy DataFrame; nothing is collected to the driver by the library.
"""

from campusflow.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
