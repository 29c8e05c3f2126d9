"""Where tables are written."""

import pytest

from panelyard.functions import scans


class Session:
    """What ``shared_folder`` asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("C", (), {"master": master})
        self.conf = type("F", (), {"get": staticmethod(lambda key, default=None: folder or default)})


def test_no_local_folder_on_a_cluster():
    assert scans.shared_folder(Session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert scans.shared_folder(Session("local[4]")) == scans.LOCAL_FOLDER
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scans.shared_folder(Session("spark://host:7077"))
