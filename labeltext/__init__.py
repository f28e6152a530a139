"""labeltext: labelled-text preparation and analysis as Spark jobs."""
