"""factlode.operators"""
