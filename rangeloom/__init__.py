"""Point-stream analytics on Spark: DataFrame operators over packets, points, voxels, poses and scans."""
