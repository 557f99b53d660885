"""Training-data mixtures as Spark DataFrame operators.

Documents become token ids, token ids become fixed-length blocks, blocks are
drawn into a weighted training stream, and the mixture weights are learned
from how well each source's head gradient agrees with a target's.  Every
public function takes and returns DataFrames; see README.md for the map.
"""

from blendwise.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
