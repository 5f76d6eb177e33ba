"""kinframe.streaming"""
