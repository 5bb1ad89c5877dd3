"""Document retrieval and analytics expressed as Spark DataFrame plans."""

from folionaut.settings import FolioError, Settings

__all__ = ["FolioError", "Settings"]
