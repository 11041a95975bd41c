"""Structured Streaming entry points.

The surveyed work reads every input once (no streams, windows or state), so
there is no stateful streaming operator to build. What carries over is that
every fitted plan here (feature plans, scalers, bins, calibrators, models) is
a pure projection once fitted, so the same objects score a streaming
DataFrame unchanged; ``scoring`` wires that up.
"""
