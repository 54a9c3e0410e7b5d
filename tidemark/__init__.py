"""Urban flood analytics on Spark: DataFrame operators over detections, events, sensors, terrain and labels."""
