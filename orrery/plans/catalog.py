"""All registered queries of the engine and their SQL."""

from orrery.plans import q_boxes, q_cameras, q_collections, q_drives, q_evaluation, q_forms, q_frames, q_geometry, q_images, q_linear, q_motion, q_scans, q_sequences, q_sources, q_trackers, q_tracks, q_views  # noqa: F401
from orrery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
